"""Fixed values that results depend on."""

#: Extensions of files that are no pages (classification).
ASSET_EXTENSIONS = (
    ".css", ".js", ".mjs", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".woff", ".woff2", ".ttf", ".eot",
    ".mp4", ".mp3", ".wav", ".zip", ".tar", ".gz", ".pdf", ".xml", ".map",
)
#: Extensions of links that are not followed (crawling).
SKIP_EXTENSIONS = (
    ".css", ".js", ".mjs", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".woff", ".woff2", ".ttf", ".eot",
    ".mp4", ".mp3", ".wav", ".ogg", ".zip", ".tar", ".gz", ".bz2", ".7z", ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".xml", ".map", ".exe", ".dmg", ".whl", ".egg", ".py", ".pyc", ".pyd", ".rst", ".md",
)
#: Beginnings of references that lead to no page.
SKIP_PREFIXES = ("#", "mailto:", "tel:", "javascript:", "data:")
#: Query keys that say where a visitor came from.
TRACKING_PARAMS = frozenset({"utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid"})
#: Language segments before a version.
LANGUAGES = ("en", "fr", "de", "es", "ja", "zh", "ko")
#: Extensions that make a dotted segment a file rather than a dotted path.
FILE_EXTENSIONS = (
    "html", "htm", "rst", "md", "php", "aspx", "txt", "json", "xml", "csv", "css", "js", "mjs", "png", "jpg", "jpeg",
    "gif", "svg", "ico", "webp", "woff", "woff2", "ttf", "eot", "mp4", "mp3", "wav", "zip", "tar", "gz", "pdf", "map", "inv",
)
#: Extensions of page-like file names.
PAGE_EXTENSIONS = ("html", "htm", "rst", "md", "php", "aspx", "txt", "json", "xml", "csv")

#: Hosts by kind, in order of priority.
DOMAIN_KINDS = {
    "package_index": ("pypi.org", "pip.pypa.io", "npmjs.com", "crates.io", "rubygems.org", "packagist.org", "nuget.org", "anaconda.org", "conda.io", "conda-forge.org"),
    "code_hosting": ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "sourceforge.net", "github.io"),
    "social_media": ("twitter.com", "x.com", "facebook.com", "linkedin.com", "reddit.com", "mastodon.social", "bsky.app", "discord.com", "discord.gg", "youtube.com", "youtu.be"),
    "qa_forum": ("stackoverflow.com", "stackexchange.com", "superuser.com", "serverfault.com", "askubuntu.com"),
    "academic": ("arxiv.org", "doi.org", "scholar.google.com", "researchgate.net", "ieee.org", "acm.org", "dl.acm.org", "link.springer.com"),
}
#: Endings of hosts that hold documentation.
DOC_HOST_ENDINGS = (".github.io", ".readthedocs.io", ".readthedocs.org")
#: Path pieces that tell documentation.
DOC_PATH_SIGNALS = (
    "/doc/", "/docs/", "/documentation/", "/api/", "/reference/", "/stable/", "/en/latest/", "/doc/stable/", "/manual/",
    "/guide/", "/tutorial/", "/_static/", "/_sources/", "/objects.inv",
)
#: Host pieces that tell documentation.
DOC_HOST_SIGNALS = ("docs.", "doc.", "wiki.", "documentation")

#: Names of templates by pieces of their group's prefix, in order of priority.
TEMPLATE_NAMES = (
    ("modules/generated", "api_reference"),
    ("user_guide", "user_guide"),
    ("auto_examples", "examples"),
    ("whats_new", "changelog"),
    ("developers", "developer_docs"),
    ("api", "api_reference"),
    ("_downloads", "downloads"),
    ("lite/lab", "interactive_lite"),
    ("modules", "module_overview"),
)
#: Site generators by path piece: (generator, piece, how many paths more than, score).
GENERATOR_PATHS = (
    ("sphinx", "/_static/searchtools.js", 0, 0.90),
    ("sphinx", "/_static/", 0, 0.70),
    ("sphinx", "/_sources/", 0, 0.75),
    ("sphinx", "/objects.inv", 0, 0.95),
    ("sphinx", "/modules/generated/", 10, 0.60),
    ("mkdocs", "/search/search_index.json", 0, 0.90),
    ("mkdocs", "mkdocs", 0, 0.60),
    ("docusaurus", "/assets/js/docusaurus", 0, 0.85),
    ("docusaurus", "docusaurus", 0, 0.50),
    ("vuepress", "/.vuepress/", 0, 0.80),
    ("hugo", "/index.json", 0, 0.50),
)
GENERATORS = ("sphinx", "mkdocs", "docusaurus", "vuepress", "hugo")
#: Values that count as no content, and the least lengths of a record's fields.
GARBAGE = ("undefined", "n/a", "page not found", "")
RECORD_FIELDS = {"page_title": 3, "function_signature": 5, "description": 10, "parameters": 0}
#: Tags that a page's skeleton leaves out.
NOISE_TAGS = ("script", "style", "svg", "noscript", "iframe", "link", "meta", "path", "circle", "rect")
#: Classes that a page's skeleton keeps.
STRUCTURAL_CLASSES = frozenset({
    "document", "body", "header", "footer", "sidebar", "content", "navbar", "nav", "main", "section", "article", "aside",
    "sig", "sig-object", "sig-name", "sig-prename", "descclassname", "descname", "field-list", "field-body", "highlight",
    "docutils", "admonition", "note", "warning", "deprecated", "versionadded", "versionchanged", "rubric", "toctree",
    "reference", "internal", "external", "code", "literal", "pre", "desc", "class", "method", "function", "attribute",
    "property", "module", "py method", "py function", "py class", "py module", "md-content", "md-sidebar", "md-header",
    "md-footer", "md-main", "tip", "info", "markdown", "toc", "breadcrumbs", "pagination", "sphx-glr",
    "sphx-glr-thumbcontainer", "sphx-glr-script-out", "sphx-glr-single-img",
})

#: An end tag closes what is open inside its element, but nothing of a higher rank; others have rank 0.
CLOSING_RANKS = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5, "head": 6, "body": 6, "html": 7}
