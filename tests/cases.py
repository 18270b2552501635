"""Literal HTML rows for the title strategies: (page_id, html, expected title)."""

_PAGE = "<html><head><title>{t}</title></head><body>{b}</body></html>"

TITLE_CASES = [
    # An attribute marks the open chat; an unmarked neighbour and a false mark do not count
    (1, _PAGE.format(t="Claude", b='<nav><a href="#a">Tomato watering</a><a href="#b" aria-selected="false">Old boats</a>'
                                   '<a href="#c" aria-selected="true"> Planning a balcony garden </a></nav><main>m</main>'), "Planning a balcony garden"),
    # A class word marks it; a class that only contains the word does not
    (2, _PAGE.format(t="Gemini", b='<aside><p class="inactive">Roof repairs</p><p class="row current">Sourdough starter diary</p></aside><main>m</main>'),
     "Sourdough starter diary"),
    # nothing but platform and list names
    (3, _PAGE.format(t="Gemini", b="<h1>Chats</h1><main><p>m</p></main>"), None),
    # The title element without its platform suffix
    (4, _PAGE.format(t="Tuning a cello at home - ChatGPT", b="<main><p>m</p></main>"), "Tuning a cello at home"),
    # T4: an element with a role holds the marked entry
    (5, _PAGE.format(t="Gemini", b='<div role="complementary"><a>Bus routes</a><a class="selected">Night train to Lyon</a></div><main>m</main>'),
     "Night train to Lyon"),
    # T5: the first user turn, up to its question mark
    (6, _PAGE.format(t="Gemini", b='<main><div data-message-author-role="user"><p>Which screws hold in drywall?</p></div>'
                                   '<div data-message-author-role="assistant"><p>Anchors first.</p></div></main>'), "Which screws hold in drywall"),
    # a no-break space before the platform suffix is white space
    (7, _PAGE.format(t="Kite building&nbsp;- ChatGPT", b="<main><p>m</p></main>"), "Kite building"),
]
