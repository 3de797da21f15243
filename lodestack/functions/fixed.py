"""Names, lists and patterns that results depend on, each as it is known in the wild."""

from __future__ import annotations

#: Extensions of files by what they are.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "avif", "ico")
AUDIO_EXTENSIONS = ("mp3", "ogg", "wav", "m4a", "aac", "flac", "opus", "weba")
VIDEO_EXTENSIONS = ("mp4", "webm", "ogv", "mkv", "mov", "m4v")
FONT_EXTENSIONS = ("woff", "woff2", "ttf", "otf", "eot")
SCRIPT_EXTENSIONS = ("js", "mjs")
STYLE_EXTENSIONS = ("css",)
DATA_EXTENSIONS = ("json", "txt", "zip")
MEDIA_EXTENSIONS = AUDIO_EXTENSIONS + VIDEO_EXTENSIONS
ASSET_EXTENSIONS = FONT_EXTENSIONS + IMAGE_EXTENSIONS + MEDIA_EXTENSIONS + STYLE_EXTENSIONS + SCRIPT_EXTENSIONS + DATA_EXTENSIONS
RUNTIME_EXTENSIONS = IMAGE_EXTENSIONS + MEDIA_EXTENSIONS + FONT_EXTENSIONS + SCRIPT_EXTENSIONS + STYLE_EXTENSIONS + ("json", "wasm", "webmanifest")

#: Content types of files that a page loads while it runs, besides pictures, sounds, films and fonts.
RUNTIME_TYPES = ("text/css", "application/javascript", "text/javascript", "application/json", "application/wasm", "application/font-woff", "application/font-woff2")

#: Fields of a project that hold a picture.
IMAGE_FIELDS = (
    "image", "backgroundImage", "rowBackgroundImage", "objectBackgroundImage", "defaultImage", "bgImage", "bg", "img", "thumbnail", "coverImage",
    "headerImage", "icon", "portrait", "avatar", "picture", "addonBackgroundImage", "rowBorderImage", "objectBorderImage", "addonBorderImage",
    "backpackBgImage", "loadingBgImage", "favicon", "negativeImage", "selectedImage", "unselectedImage", "borderImage", "loadingImage", "rowImage",
    "choiceImage",
)

#: Fields of a project that hold a sound, and fields that hold a list of sounds (in lower case).
AUDIO_FIELDS = (
    "audio", "audioSrc", "backgroundMusic", "backgroundAudio", "rowAudio", "objectAudio", "soundEffect", "sfx", "bgm", "ambience", "voiceover",
    "narration", "soundFile", "audioFile", "musicFile", "clickSound", "hoverSound", "selectSound", "musicUrl", "audioUrl", "soundUrl",
)
PLAYLIST_FIELDS = ("bgmlist", "bgmplaylist", "bgmtracks", "playlist", "audiolist", "musiclist", "bgmqueue")

#: Fields that make an object a project; in text only the first 21 count.
PROJECT_FIELDS = (
    "rows", "backpack", "cards", "sections", "scenes", "pages", "tabs", "choices", "name", "title", "author", "theme", "meta", "character", "points",
    "imageSets", "templates", "objects", "groups", "words", "variables", "defaultRowTitle", "defaultChoiceTitle", "pointTypes", "chapters", "version",
)
PROJECT_TEXT_FIELDS = PROJECT_FIELDS[:21]

#: Fields of a catalogue record that link to a project.
RECORD_FIELDS = ("iframe_url", "iframeUrl", "url", "link", "source", "embed", "project_url", "game_url")

#: Hosts that only measure, and suffixes of such.
TELEMETRY_HOSTS = (
    "www.googletagmanager.com", "googletagmanager.com", "www.google-analytics.com", "google-analytics.com", "stats.g.doubleclick.net", "cct.google",
    "vercel.live", "www.clarity.ms", "clarity.ms", "browser.sentry-cdn.com",
)
TELEMETRY_SUFFIXES = (".sentry.io", ".posthog.com")

#: Hosts that are about a project, not the project, and parts of links of that kind.
SOCIAL_HOSTS = (
    "github.com", "discord.com", "discord.gg", "twitter.com", "x.com", "facebook.com", "instagram.com", "reddit.com", "google-analytics.com",
    "googletagmanager.com",
)
ASIDE_TOKENS = ("/profile/", "/docs/", "/documentation/", "utm_")

#: References that are no download, and paths that are no part of a story.
NO_REFERENCE = r"(?i)^(data:|javascript:|mailto:|file:|ftp:|blob:|chrome:|about:|#)"
SKIPPED_PATHS = r"(?i)/(?:api|auth|login|logout|sign-in|signin|signup|register|account|admin|checkout|payment)(?:/|$)"

#: Modes of a queue row, spellings of them, and what they ask for.
MODES = (
    "auto", "embed", "zip", "both", "icc", "icc_zip", "icc_folder", "website", "website_zip", "website_folder", "pure_website", "pure_website_zip",
    "pure_website_folder", "cyoap_vue", "cyoap_vue_zip", "cyoap_vue_folder",
)
MODE_SPELLINGS = {"icc": "website_zip", "icc_zip": "website_zip", "icc_folder": "website_folder"}
PURE_MODES = ("pure_website", "pure_website_zip", "pure_website_folder")
VUE_MODES = ("cyoap_vue", "cyoap_vue_zip", "cyoap_vue_folder")
WEBSITE_MODES = ("icc", "icc_zip", "icc_folder", "website", "website_zip", "website_folder")
FOLDER_MODES = ("icc_folder", "website_folder", "pure_website_folder", "cyoap_vue_folder")

#: What a page says that wants to see a browser first.
CHALLENGE_MARKERS = (
    "cf-browser-verification", "challenge-platform", "jschl_vc", "jschl-answer", "cf_clearance", "Checking your browser",
    "Enable JavaScript and cookies", "cf-turnstile", "DDoS protection",
)

#: Pairs of marks of hand-written viewers, in lower case.
VIEWER_MARKERS = (('id="cyoa-container"', "game_data"), ("id='cyoa-container'", "game_data"), ('id="bg-music"', "point-bar"), ("id='bg-music'", "point-bar"))

#: Words of controls that may be pressed, and of those that may not.
SAFE_LABELS = r"(?i)\b(?:load|show|view|read)\s+more\b|\bnext\b|\bcontinue\b|\bexpand\b|\breveal\b|\bopen\s+section\b|\bmuat\s+lagi\b|\btampilkan\b|\bselanjutnya\b|\blanjut\b"
UNSAFE_LABELS = (
    r"(?i)\b(?:log\s*in|login|sign\s*in|sign\s*up|register|submit|send|report|like|upvote|downvote|pay|buy|purchase|donate|subscribe|checkout|delete|"
    r"logout|share|upload|comment|patreon|boosty)\b"
)

#: Reports in a package that may be empty.
REPORT_NAMES = ("backup_report.txt", "failed_assets.txt", "failed_images.txt", "failed_urls.txt", "skipped_youtube_audio.txt")

#: The part of a job's progress that each state covers.
STAGE_BANDS = {
    "IDLE": (0.0, 0.0), "RESOLVING": (0.0, 0.05), "FETCHING_ENTRY": (0.05, 0.10), "DISCOVERING_ASSETS": (0.10, 0.25), "DOWNLOADING": (0.25, 0.85),
    "RETRYING": (0.25, 0.85), "REWRITING": (0.85, 0.92), "VERIFYING": (0.92, 0.97), "PACKAGING": (0.97, 0.995), "COMPLETED": (1.0, 1.0),
    "COMPLETED_WITH_WARNINGS": (1.0, 1.0), "FAILED": (0.0, 0.995), "CANCELLING": (0.0, 0.995), "CANCELLED": (0.0, 0.995),
}

#: Names of a project's data file, and folders where it may lie, the likeliest first.
DATA_NAMES = ("project.json", "project.txt", "project.zip")
OTHER_DATA_NAMES = (
    "data.json", "app.json", "cyoa.json", "content.json", "index.json", "iccplus.json", "data.txt", "main.json", "game.json", "story.json",
    "adventure.json", "choices.json", "app.data.json", "project.data.json",
)
DATA_FOLDERS = ("app/", "data/", "assets/", "project/")
OTHER_DATA_FOLDERS = (
    "public/", "dist/", "src/", "static/", "files/", "content/", "json/", "resources/", "media/", "game/", "cyoa/", "viewer/", "js/data/", "js/",
    "scripts/", "config/",
)

#: Links to videos and sounds, and ids of videos in text.
VIDEO_LINK = r"(?i)(?:https?://)?(?:www\.)?(?:youtube\.com|youtu\.be|youtube-nocookie\.com)/"
SOUND_LINK = r"(?i)(?:https?://)?(?:www\.)?soundcloud\.com/"
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"
VIDEO_ID_IN_TEXT = r"""(?i)(?:playVideo|youtube(?:Id|VideoId)?)\s*[:=(]\s*['"]([A-Za-z0-9_-]{11})['"]"""
VIDEO_LINK_IN_TEXT = r"""(?i)https?://(?:www\.)?(?:youtube\.com|youtu\.be|youtube-nocookie\.com)/[^\s'"<>\\]+"""
WATCH_LINK = "https://www.youtube.com/watch?v="

#: Extensions of assets that texts name, and of pictures in lists.
TEXT_ASSET_EXTENSIONS = (
    "webp", "avif", "png", "jpg", "jpeg", "gif", "svg", "ico", "bmp", "tiff", "mp3", "ogg", "opus", "wav", "m4a", "aac", "flac", "mp4", "webm", "mov", "ogv", "m4v",
    "woff2", "woff", "ttf", "otf", "eot", "json", "css", "wasm",
)
LISTED_PICTURES = ("webp", "avif", "png", "jpe?g", "gif", "svg", "ico", "bmp", "tiff")

#: How scripts open data files, an application's script in a bootstrap, and where inline scripts say that data is.
OPENED_FILES = (
    r"""e\.open\(\s*["']GET["']\s*,\s*["']([^"']+)["']""",
    r"""(?i)(?:fetch|axios\.get|axios\(|load|request)\s*\(\s*["']([^"']+\.(?:json|txt|zip))["']""",
    r"""(?i)\.open\s*\(\s*["']GET["']\s*,\s*["']([^"']+)["']""",
)
BOOTSTRAP_SCRIPT = r"""js/app\.[^'"]+\.js"""
SCRIPT_HINT = (
    r"""(?i)window\.__(?:PROJECT|APP|DATA|CYOA|INITIAL_STATE)__\s*=\s*["'][^"']+["']|"""
    r"""(?:fetch|axios\.get|axios\(|open)\s*\(\s*["'][^"']+\.(?:json|txt|zip)["']"""
)

#: Folders below a page where its pictures and its sounds may lie.
PICTURE_FOLDERS = ("dist/images/",)
SOUND_FOLDERS = ("dist/audio/", "dist/media/", "dist/images/", "audio/", "media/")

#: Parts of the names of scripts that are an application's, and of those that are libraries.
APPLICATION_SCRIPTS = ("app.", "/app.", "app.js", "/js/app", "main.", "/main.", "main.js", "/index.", "runtime.")
LIBRARY_SCRIPTS = ("chunk-vendors", "vendors", "vendor.", "polyfills", "webpack")

#: Names of scripts that are bundles, and what scripts say that make up addresses while they run.
BUNDLE_NAME = (
    r"(?i)(?:^|/)(?:app|main|index|chunk-vendors?|vendors?|runtime|polyfills?|core|working)"
    r"(?:[._-][a-zA-Z0-9_-]{4,})?(?:-legacy)?(?:[._-][a-zA-Z0-9_-]{4,})?\.m?js$"
)
LOADER_BASE = r"""(?i)basePath\s*=\s*new URL\(["']\.\./"""
LOADER_PATHS = r"__webpack_public_path__|__publicPath__"

#: Extensions by which files without one are told.
SNIFFED_PICTURES = ("png", "jpg", "jpeg", "gif", "webp", "avif", "bmp", "svg", "ico", "tif", "tiff")
SNIFFED_SOUNDS = ("mp3", "ogg", "wav", "m4a", "aac", "opus", "flac", "weba")
SNIFFED_TEXTS = ("css", "js", "mjs", "cjs", "json", "txt", "html", "htm")

#: What errors say of locked cookies and of checks for robots.
COOKIE_LOCKS = ("could not copy chrome cookie database", "could not copy chromium cookie database", "permission denied", "access is denied")
BOT_CHECKS = (
    "sign in to confirm", "bot", "confirm your age", "private video", "video unavailable", "http error 403", "this video is not available",
)

#: Hosts of a gallery's raw files, and parts of the paths of its pages.
RAW_PICTURE_HOSTS = (
    "i.pximg.net", "img-original.pximg.net", "img-zip-ugoira.pximg.net", "pbs.twimg.com", "c.deviantart.com", "a.deviantart.net", "wixmp.com",
    "cdn.donmai.us", "static1.e621.net", "static1.e926.net", "img3.sankakucomplex.com", "img.sankakucomplex.com", "img1.gelbooru.com",
    "img2.gelbooru.com", "img.hypnohub.net", "img.rule34.xxx", "img3.rule34.xxx", "img.rule34.paheal.net",
)
GALLERY_PARTS = ("/artworks/", "/posts/", "/post/", "/view/", "/gallery/", "/status/")

#: A catalogue's host, marks of viewer pages, and those that its own pages need.
CATALOGUE_HOST = "cyoa.cafe"
VIEWER_MARKS = (
    'id="app"', "id='app'", "interactive cyoa creator", "interactive cyoa", "project.json", "project.txt", "dist/platform.json", "dist/nodes/list.json",
    "window.app", "cyoa-viewer", "loading omnitrix",
)
STRONG_MARKS = ("iframe", "project.json", "interactive cyoa creator")

#: Hints of viewers by their type, the types that modes ask for, and the mark of a remix.
VIEWER_HINTS = {
    "icc_plus": (
        "app.c533aa25", "chunk-vendors", "ICC+", "icc-plus", "ICCPlus", "core.js", "basePath +", "app.B6d7tc9y", "app_BuGW6RFa", "vite_is_modern_browser",
    ),
    "icc_remix": ("ICC_PROJECT_DATA_SCRIPT", "icc_remix", "ICCRemix", "app.offline.js"),
    "om1cr0n": ("Om1cr0n", "animation.webp", "Bad End", "color-schema", "assets/index-", "font-sans dark:text-white"),
    "cyoap_vue": ("platform.json", "cyoap", "cyoa_plus"),
    "custom": (),
}
VIEWER_MODES = {
    "website_zip": "icc_plus", "website_folder": "icc_plus", "pure_website_zip": "custom", "pure_website_folder": "custom", "cyoap_vue_zip": "cyoap_vue",
    "cyoap_vue_folder": "cyoap_vue",
}
REMIX_TEMPLATE = "{{ICC_PROJECT_DATA_SCRIPT}}"

#: What stands before a project's brace, or ends with it, in scripts, the likeliest first; patterns of such, all of which end with it; and names
#: in a project, near which its braces lie when nothing else says so.
EMBEDDED_MARKERS = (
    "Store({state:{app:", "state:{app:", "__INITIAL_STATE__=", "__INITIAL_STATE__ =", "window.__APP__=", "window.__APP__ =", "window.__NUXT__=", "window.__NUXT__ =",
    "app:{", '"app":{', "project:{", '"project":{',
)
EMBEDDED_PATTERNS = (
    r"(?i)\b(?:app|project)\s*=\s*[A-Za-z_$][\w$]*\s*\(\s*\{", r"(?:app|project)\s*:\s*\{", r'"(?:app|project)"\s*:\s*\{',
    r"(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*\{", r"return\s*\{",
)
EMBEDDED_NAMES = (
    r"""["\']rows["\']\s*:""", r"\brows\s*:", r"""["\']backpack["\']\s*:""", r"\bbackpack\s*:", r"""["\']groups["\']\s*:""", r"""["\']words["\']\s*:""",
)
