"""Rule catalogues.

Fixed values: the word lists, paths and patterns below define the categories that
results must carry. Every classifier takes its catalogue as an argument, so a
caller can swap any of them.
"""

from __future__ import annotations

BOT_UA_SUBSTRINGS = [
    "bot", "crawl", "spider", "slurp", "mediapartners", "lighthouse", "pagespeed",
    "pingdom", "uptimerobot", "headlesschrome", "python-requests", "curl/", "wget/",
    "go-http-client", "apache-httpclient",
]

# (category, kind, pattern) in order of precedence; the first match wins.
# kinds: re = regex on the URL, re_decoded = also on the decoded URL,
# re_lower/prefix_lower/equals_lower/path_lower = on the lower-cased URL
# (path_lower ignores trailing slashes), prefix = case-sensitive prefix.
SPONSOR_PATHS = [
    "/mediakit", "/media-kit", "/publicite", "/publicidad", "/werbung", "/rate-card",
    "/advertise", "/advertise-with-us", "/sponsors", "/sponsorship", "/partnerships",
    "/partner-with-us", "/about-us", "/aboutus", "/our-team", "/team", "/kontakt",
    "/impressum", "/chi-siamo", "/over-ons", "/ueber-uns", "/uber-uns", "/get-in-touch",
    "/contactus", "/reach-us", "/inquiry", "/a-propos", "/sobre", "/sobre-nosotros",
    "/contato", "/anuncie", "/pubblicita", "/mediadaten", "/contatti", "/fale-conosco",
    "/neem-contact-op", "/expediente", "/ficha-tecnica", "/institucional", "/instituicao",
    "/nosotros", "/contacto", "/nous-contacter", "/qui-sommes-nous", "/enquiry",
    "/publicidade",
]
SQL_INJECTION_URL = r"""(?i)select\(|sleep\(|union\+select|1'\""""
SECRET_URL = (
    r"(?i)(?:^|/)(?:\.env|\.env\.|\.git/|\.gitignore$|\.svn/|\.hg/|\.bzr/|\.aws/|\.ssh/"
    r"|\.npmrc$|\.htpasswd$|\.htaccess$|\.vscode/|\.idea/|\.well-known/[^/]*\.bak)"
)
CONFIG_URL = (
    r"(?i)(?:^|/)(?:wp-config\.php\.[a-z0-9]+|credentials\.[a-z]+|config\.(?:json|php\.bak|yml|yaml)"
    r"|secrets?\.[a-z]+|backup\.(?:zip|sql|tar|tar\.gz|tgz)|db\.sql|database\.sql|dump\.sql"
    r"|.*\.sql\.gz|robots\.txt\.bak|sftp\.json|laravel\.log|telescope/|actuator/|phpinfo\.php"
    r"|info\.php|server\.php)"
)
SCANNER_URL = (
    r"(?i)(?:^|/)(?:etc/(?:passwd|shadow|hosts)|windows/(?:win\.ini|system32)|win\.ini|boot\.ini"
    r"|proc/self(?:/|$)|package(?:-lock)?\.json|composer\.(?:json|lock)|yarn\.lock"
    r"|gemfile(?:\.lock)?|requirements\.txt|pipfile(?:\.lock)?|web-inf/|meta-inf/)"
    r"|(?:^|/)[^?]*\.(?:jsp|jspx)(?:[/?#%]|$)"
)
NOT_FOUND_RULES = [
    ("sql-injection", "re", SQL_INJECTION_URL),
    ("secret-probe", "re", SECRET_URL),
    ("config-probe", "re", CONFIG_URL),
    ("scanner-path-probe", "re_decoded", SCANNER_URL),
    ("wpjson-user-enum", "re", r"(?i)/wp-json/wp/v2/users"),
    ("ad-sponsor-probe", "path_lower", SPONSOR_PATHS),
    ("legacy-html", "re", r"(?i)\.html"),
    ("missing-upload", "prefix", ["/wp-content/uploads/"]),
    ("plugin-probe", "prefix", ["/wp-content/plugins/"]),
    ("wp-includes-probe", "prefix", ["/wp-includes/"]),
    ("php-probe", "re", r"(?i)\.php\d?"),
    ("ad-txt", "equals_lower", ["/ads.txt", "/app-ads.txt", "/sellers.json", "/security.txt"]),
    ("bot-probe", "equals_lower", ["/login/", "/admin/", "/cgi-bin/", "/getcmd/", "/ip", "/xmlrpc/"]),
    ("author-enum", "re", r"^/?\?author="),
    ("old-sitemap", "prefix_lower", ["/sitemap"]),
    ("community-thread", "prefix", ["/t/"]),
    ("events", "prefix", ["/events/"]),
    ("festival", "prefix_lower", ["/festival"]),
    ("date-prefix", "re", r"^/\d{4}/\d{2}/"),
    ("join-page", "path_lower", ["/join"]),
]
NOT_FOUND_DEFAULT = "content"
ACTIONABLE_404 = [
    "legacy-html", "content", "date-prefix", "missing-upload", "ad-txt", "community-thread",
    "events", "festival", "old-sitemap", "join-page",
]
SCANNER_404 = [
    "sql-injection", "secret-probe", "config-probe", "scanner-path-probe", "wpjson-user-enum",
    "php-probe", "plugin-probe", "wp-includes-probe", "bot-probe", "author-enum",
    "ad-sponsor-probe",
]
REDIRECTABLE_404 = ["legacy-html", "content", "date-prefix"]

# (pattern name, family, regex, match the raw text instead of the decoded one)
SEARCH_PAYLOAD_RULES = [
    ("time_based_sqli", "sqli", r"(?i)\bsleep\s*\(\s*\d+\s*\)", False),
    ("time_based_sqli", "sqli", r"(?i)\bwaitfor\s+delay\b", False),
    ("time_based_sqli", "sqli", r"(?i)\bDBMS_PIPE\.RECEIVE_MESSAGE\b", False),
    ("time_based_sqli", "sqli", r"(?i)\bbenchmark\s*\(\s*\d+", False),
    ("time_based_sqli", "sqli", r"(?i)\bpg_sleep\s*\(", False),
    ("boolean_sqli", "sqli", r"(?i)\bunion\s+(?:all\s+)?select\b", False),
    ("boolean_sqli", "sqli", r"(?i)\bselect\s*\(\s*\d+\s*\)\s*from\s*\(\s*select\b", False),
    ("boolean_sqli", "sqli", r"(?i)\bxor\s*\(\s*\d+\s*\*\s*if\s*\(", False),
    ("xss_script_tag", "xss", r"(?i)<script\b", False),
    ("xss_event_handler", "xss", r"(?i)\bon(?:error|load|click|mouseover)\s*=", False),
    ("xss_javascript_uri", "xss", r"(?i)javascript\s*:", False),
    ("blind_xss_callback", "xss", r"(?i)bxss\.me", False),
    ("code_exec_md5_probe", "rce", r"(?i)\bprint\s*\(\s*md5\s*\(\s*\d+\s*\)\s*\)", False),
    ("code_exec_base64_probe", "rce", r"(?i)\b(?:assert|eval)\s*\(\s*base64_decode\s*\(", False),
    ("path_traversal", "lfi", r"\.\./\.\.", False),
    ("path_traversal", "lfi", r"(?i)/etc/(?:passwd|shadow|group|hosts|shells)\b", False),
    ("scanner_marker", "scanner", r"^@@[A-Za-z0-9]{4,8}$", False),
    (
        "scanner_quote_probe", "scanner",
        r"""(?i)^[a-z0-9/]{0,40}(?:'|&#039;|&apos;)+(?:"|&quot;)+(?:\d{1,4})?$""", False,
    ),
    ("scanner_path_enum", "scanner", r"(?i)/page(?:/[a-z0-9]+)+\.(?:html|jsp|asp|aspx|php)$", False),
    ("scanner_path_enum", "scanner", r"(?i)/page/page", False),
    ("scanner_quote_probe", "scanner", r"""(?:\\\\'|\\\\")|^['"]+\\+['"]+$""", False),
    ("scanner_encoded_gibberish", "scanner", r"\?{3,}%25", True),
    ("scanner_encoded_gibberish", "scanner", r"(?i)%25(?:27|22)%25(?:27|22)", True),
    ("dependency_manifest_probe", "scanner", r"(?i)\bGemfile(?:\.lock)?\b", False),
    ("length_abuse", "abuse", r"(?s)^.{300,}$", False),
]
HTML_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#039;", "'"), ("&amp;", "&"),
]

SEARCH_SURFACE_MARKERS = ["/search/", "?s=", "&s=", "/page/", "?paged=", "&paged="]
FORUM_SEARCH_MARKER = "bbp_search"

OUTBOUND_RULES = [
    ("spotify", ["open.spotify.com", "spotify.com", "spoti.fi"]),
    (
        "social",
        [
            "instagram.com", "facebook.com", "fb.com", "twitter.com", "x.com", "tiktok.com",
            "youtube.com", "youtu.be", "threads.net", "bsky.app", "reddit.com", "snapchat.com",
            "pinterest.com", "linkedin.com",
        ],
    ),
    (
        "ticketing",
        [
            "ticketmaster.com", "livenation.com", "eventbrite.com", "dice.fm", "seetickets.us",
            "seetickets.com", "axs.com", "etix.com", "ticketweb.com", "showclix.com", "tixr.com",
            "stubhub.com", "seatgeek.com",
        ],
    ),
    (
        "artist-site",
        [
            "bandcamp.com", "linktr.ee", "soundcloud.com", "music.apple.com", "tidal.com",
            "audiomack.com", "bandsintown.com",
        ],
    ),
    ("merch", ["shopify.com", "bigcartel.com", "merchbar.com", "teespring.com", "storenvy.com"]),
]
OUTBOUND_DEFAULT = "other"

FORMAT_RULES = [
    ("song-meaning", ["song-meanings", "song-meaning", "lyrics", "lyric-meanings"]),
    ("guitar-history", ["guitar-history", "guitars", "gear", "famous-guitars"]),
    ("music-history", ["music-history", "history", "band-art"]),
    (
        "charleston-local",
        [
            "charleston", "charleston-music", "local", "local-music", "sc-music",
            "south-carolina", "columbia", "savannah",
        ],
    ),
    ("interview", ["interviews", "interview", "q-a", "qa"]),
    ("trivia", ["trivia", "quiz", "quizzes", "facts", "did-you-know"]),
    ("listicle", ["lists", "listicles", "rankings", "best-of", "roundups", "top-10", "playlists"]),
    (
        "explainer",
        ["explainers", "explainer", "guides", "how-to", "how-tos", "music-theory", "education"],
    ),
    (
        "news",
        [
            "news", "music-news", "premieres", "festival-wire", "festivals", "live-music",
            "live-music-reviews", "shows", "concerts", "reviews",
        ],
    ),
]
FORMAT_TRIVIA_TITLE = r"\b(quiz|trivia|how well do you know)\b"
FORMAT_LIST_TITLE = r"^\s*\d+\s+|\b(best|top)\s+\d+\b"
FORMAT_DEFAULT = "uncategorized"
LEGACY_HTML_URL = r"(?i)\.html(?:[/?#]|$)"

REVENUE_ROUTE_RULES = [
    ("home", r"^/$"),
    ("pagination", r"^/page/\d+(/|$)"),
    ("legacy-html", r"\.html(?:[/?#]|$)"),
    (
        "taxonomy-archive",
        r"^/(location|locations|category|categories|tag|tags|t|festival|festivals|artist|artists"
        r"|venue|venues)(/|$)",
    ),
    (
        "app-account",
        r"^/(account|accounts|app|apps|login|log-in|signin|sign-in|register|sign-up|signup|member"
        r"|members|my-|dashboard|cart|checkout|wp-|wp-admin|wp-login)(/|$)",
    ),
]

ACTIVATION_STEPS = ["artist_signup_started", "artist_profile_created", "artist_profile_first_publish"]
ACTIVATION_FRICTION = ["artist_profile_duplicate_created", "user_reregistration_attempt"]
ACTIVATION_ACCESS = ["artist_access_requested", "artist_access_approved", "artist_access_granted"]
CONVERSION_OUTCOMES = [
    "newsletter_signup", "user_registration", "onboarding_completed", "artist_profile_first_publish",
]
LIFECYCLE_OUTCOMES = ["onboarding_completed", "artist_profile_first_publish"]
