"""loomdown: saved AI-chat pages and parsed conversations to Markdown notes, as Spark jobs.

Pages are exploded into a node table (one row per HTML token, nested-set intervals), page chrome is removed with
window-based subtree filters, titles, Markdown, language tags and note files are derived with built-in Spark SQL
functions, windows, joins and aggregations.
"""

from loomdown.options import Options, load_options

__all__ = ["Options", "load_options"]
