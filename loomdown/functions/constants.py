"""Fixed values that must equal the behaviour being reproduced (names, labels, markers, word lists, patterns).

They are stated here plainly, in their natural order. List order is semantic where noted.
"""

# ---- fixed values: platform names, in order (the longer of two overlapping names comes first) ----
PLATFORM_NAMES = ["Google Gemini", "Gemini", "ChatGPT", "GPT-4o", "GPT-4", "Claude", "Copilot", "Perplexity", "DeepSeek"]

# ---- fixed values: generic UI labels that are never titles ----
UI_LABELS = [
    "chats", "new chat", "recent", "recent chats", "history", "conversations", "starred", "pinned", "all chats",
    "home", "settings", "help", "feedback", "send a message",
]

# ---- fixed values: label -> language, order is semantic (first label found in the text wins) ----
LABEL_LANGS = [
    ("c++", "cpp"), ("cpp", "cpp"), ("c plus plus", "cpp"),
    ("python", "python"), ("py ", "python"),
    ("javascript", "javascript"), ("js ", "javascript"), ("js code", "javascript"),
    ("typescript", "typescript"), ("ts ", "typescript"),
    ("java", "java"),
    ("rust", "rust"),
    ("go ", "go"), ("golang", "go"),
    ("ruby", "ruby"),
    ("sql", "sql"),
    ("bash", "bash"), ("shell", "bash"), ("terminal", "bash"),
    ("html", "html"),
    ("css", "css"),
    ("c#", "csharp"), ("csharp", "csharp"),
    ("kotlin", "kotlin"),
    ("swift", "swift"),
    ("r ", "r"), ("r code", "r"),
    ("php", "php"),
    ("dart", "dart"),
]

# ---- fixed values: code-fence marker -> language tag (markers are matched as substrings) ----
FENCE_LANGS = [
    ("```python", "python"), ("```py", "python"),
    ("```cpp", "cpp"), ("```c++", "cpp"),
    ("```javascript", "javascript"), ("```js", "javascript"),
    ("```typescript", "typescript"), ("```ts", "typescript"),
    ("```java", "java"),
    ("```rust", "rust"), ("```rs", "rust"),
    ("```go", "go"),
    ("```ruby", "ruby"), ("```rb", "ruby"),
    ("```sql", "sql"),
    ("```bash", "bash"), ("```sh", "bash"),
    ("```html", "html"),
    ("```css", "css"),
    ("```csharp", "csharp"), ("```c#", "csharp"),
    ("```kotlin", "kotlin"), ("```kt", "kotlin"),
    ("```swift", "swift"),
    ("```r", "r"),
    ("```php", "php"),
    ("```dart", "dart"),
]

# ---- fixed values: filler openings and endings removed from titles (applied longest first) ----
FILLER_STARTS = [
    "can you ", "could you ", "please ", "i want to ", "i need to ",
    "i want you to ", "i need you to ", "i would like to ", "help me ",
    "tell me ", "show me ", "write me ", "give me ", "explain to me ",
    "explain me ", "explain ", "what is ", "what are ", "how to ",
    "how do i ", "how can i ", "how do you ", "what does ", "what do ",
    "i am ", "i'm ", "we need to ", "let's ", "let us ",
]
FILLER_ENDS = [
    " please", " thanks", " thank you", " for me", " asap",
    " in detail", " with examples", " with example",
    " step by step", " briefly",
]

# ---- fixed values: words kept lower-case in title case (except the first word) ----
SMALL_WORDS = ["a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "by", "in", "of", "is", "it", "vs", "with"]

# ---- fixed values: regular expressions (case-insensitive searches) ----
SIDEBAR_CLASS_RE = (
    r"sidebar|side-bar|sidenav|side.nav|drawer|nav[-_]?rail|"
    r"chat[-_]?list|conversation[-_]?list|history[-_]?panel|"
    r"left[-_]?panel|left[-_]?nav|menu[-_]?panel|"
    r"threads[-_]?list|thread[-_]?list"
)
SIDEBAR_ARIA_RE = r"conversation|recent chat|chat history|sidebar|navigation|threads|previous chat|menu"
OVERLAY_CLASS_RE = r"tooltip|popover|modal|overlay|backdrop|snackbar"
USER_MSG_CLASS_RE = (
    r"user[-_]?message|human[-_]?message|query[-_]?message|"
    r"user[-_]?turn|human[-_]?turn|request[-_]?row|"
    r"user[-_]?row|prompt[-_]?row"
)
ACTIVE_CLASS_RE = r"\bselected\b|\bactive\b|\bcurrent\b|\bhighlighted\b"
SIDEBAR_SUFFIX_RE = (
    r"\s*(?:Pinned(?:\s+Chat)?|Starred(?:\s+Chat)?|Archived(?:\s+Chat)?"
    r"|Shared(?:\s+Chat)?|Draft|Today|Yesterday"
    r"|Last\s+\d+\s+days|This\s+week|This\s+month"
    r"|\d+\s+(?:hour|minute|day|week|month)s?\s+ago)\s*$"
)
TITLE_SEPARATORS = " -–—|:"

# ---- fixed values: element sets used by the clean-up stages ----
DROP_TAGS_FULL_PAGE = ["button", "svg", "nav", "footer", "script", "style", "header"]
DROP_TAGS_ANSWER = ["button", "svg", "img", "nav", "footer", "script", "style"]
BRANDING_PARENTS = ["h1", "h2", "h3", "h4", "h5", "h6", "span", "div", "a", "p", "label"]
OVERLAY_ROLES = ["dialog", "tooltip", "alertdialog"]
CONTAINER_TAGS = ["div", "li", "article", "section"]
LABEL_BLOCK_TAGS = ["p", "div", "h3", "h4", "h5", "li", "span"]
ACTIVE_ATTRS = [("aria-selected", "true"), ("aria-current", "page"), ("aria-current", "true"), ("data-is-selected", "true")]
USER_ATTRS = [("data-message-author-role", "user"), ("data-turn-role", "human"), ("data-role", "user")]
SIDEBAR_MAX_TEXT = 5000
ANSWER_MIN_TEXT = 20
LABEL_SEARCH_LIMIT = 4
USER_TITLE_MAX = 120

# ---- HTML tokenizer vocabulary (HTML standard, not specific to any tool) ----
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RAW_TAGS = ["script", "style", "textarea", "title"]
NAMED_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"),
    ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&bull;", "•"),
    ("&trade;", "™"), ("&times;", "×"), ("&euro;", "€"),
]
# Markdown rendering contract (ours): elements that start and end a block
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li",
    "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tr", "ul", "head",
]
