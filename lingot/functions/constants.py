"""Word lists, patterns and tables on which results depend."""

from __future__ import annotations

# Labels of game interfaces.
UI_WORDS = (
    "ok", "yes", "no", "on", "off", "go", "hp", "mp", "xp", "lv", "start", "play", "continue", "load", "save", "options",
    "settings", "exit", "quit", "back", "next", "help", "sound", "music", "language", "score", "level", "pause", "resume",
    "select", "menu", "loading", "cancel", "retry", "buy", "sell", "shop", "inventory", "items", "item", "equip", "attack",
    "defend", "skill", "skills", "mission", "missions", "quest", "quests", "map", "new game", "game over", "press start",
    "high score", "new record", "try again", "main menu",
)
# Common words of prose.
HINT_WORDS = (
    "the", "a", "an", "to", "of", "for", "from", "with", "and", "or", "is", "are", "you", "your", "this", "that", "please",
    "press", "choose", "select", "enter", "cannot", "failed", "complete", "completed", "locked", "unlocked", "bonus", "time",
    "life", "lives", "points", "stage", "world", "enemy", "player", "game",
)
# Words of code.
TECHNICAL_WORDS = (
    "run", "init", "initialize", "destroy", "destroyapp", "startapp", "pauseapp", "paint", "repaint", "draw", "drawstring",
    "update", "tick", "loop", "render", "loadimage", "loadresource", "get", "set", "add", "remove", "insert", "delete", "read",
    "write", "flush", "close", "connect", "disconnect", "send", "receive", "encode", "decode", "parse", "serialize",
    "deserialize", "execute", "invoke", "keypressed", "keyreleased", "pointerpressed", "pointerreleased", "commandaction",
    "sizechanged", "notifydestroyed", "platformrequest", "main", "null", "true", "false", "undefined", "exception", "errorcode",
)
# Commands of engine scripts.
SCRIPT_WORDS = (
    "action", "backward", "control", "delay", "fadein", "fadeout", "film", "flash", "halt", "imagemap", "mark", "mask", "movie",
    "nfopen", "nofight", "paycall", "pcenter", "poem", "psound", "push", "random", "reset", "saction", "sanimation", "scenter",
    "spro", "sserial", "ssound", "state", "still", "text", "trigger", "setx", "sety", "xmove", "xmoveto", "ymove", "ymoveto",
    "verify", "result", "record1", "record2", "record3", "minl", "ml", "al", "part", "pay",
)
# Parts of paths that suggest language, and that suggest code.
PATH_HINTS = ("lang", "language", "locale", "localization", "l10n", "i18n", "text", "texts", "string", "strings", "message", "messages", "menu", "dialog", "english", "en_", "/en/", "caption", "label", "labels", "subtitle")
CODE_PATHS = ("/lib/", "/libs/", "/engine/", "/crypto/", "/codec/", "/network/", "/http/", "/util/", "/utils/", "/debug/", "/test/", "/tests/")
PLATFORM_REFERENCES = ("java/lang/", "javax/microedition/", "javax.microedition.", "com/nokia/", "com.siemens.", "bluetooth.", "socket://", "http://", "https://")
# Punctuation that is stripped from labels.
LABEL_STRIP = " .,!?:;…-'\""
# Shapes of technical strings, matched whole unless they say otherwise.
SHAPES = {
    "url": r"(?i)^(?:https?|ftp|file|jar):[/\\]",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "descriptor": r"^(?:\[*[BCDFIJSZV]|\[*L[A-Za-z0-9_/$]+;|\([^)]*\)[BCDFIJSZV]|\([^)]*\)L[A-Za-z0-9_/$]+;)$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "hex": r"^(?:0x)?[0-9a-fA-F]{8,}$",
    "markup": r"^</?[A-Za-z][^>]*>$",
    "mime": r"(?i)^[a-z]+/[a-z0-9.+-]+$",
    "package": r"^(?:[a-zA-Z_$][\w$]*\.){2,}[A-Za-z_$][\w$]*$",
    "path": r"^(?:[A-Za-z0-9_.-]+[/\\])+[A-Za-z0-9_.-]+$",
    "path_fragment": r"^(?:[/\\][A-Za-z0-9_.-]+)+[/\\]?$",
    "metadata_key": r"(?i)^MIDlet-[A-Za-z0-9-]+$",
    "file_name": r"(?i)\.(?:class|java|jar|zip|png|jpg|jpeg|gif|bmp|mid|midi|mp3|wav|amr|dat|bin|res|xml|json|properties|txt|cfg|ini|rms|db|pak|so|dll|exe)$",
    "extension": r"^\.[A-Za-z0-9]{1,8}$",
    "printf": r"^(?:%[-+#0-9.*$]*[a-zA-Z]\s*)+$",
    "constant": r"^[A-Z][A-Z0-9_]{4,}$",
    "snake_case": r"^[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+$",
    "camel_case": r"^[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*$",
    "engine_token": r"(?i)^[acdfjmps](?:mission|player|save|speed|action|serial|sound|sprite|center|pro)$",
    "bracket_command": r"^[A-Za-z][A-Za-z0-9_]*\[$",
    "command_script": r"(?i)(?:^|[;\s])(?:aplayer|splayer|magic|item|equip|stage|scene|trigger|event|money|pay)\s+[^;]+;",
    "printable_ascii": r"^[\x20-\x7e]+$",
    "identifier": r"^[A-Za-z_$][A-Za-z0-9_$]*$",
    "upper_camel": r"^[A-Z][A-Za-z0-9]{4,}$",
    "numeric_label": r"(?i)^(?:level|stage|round|wave|world|mission|quest|score|time|life|lives|hp|mp|xp)\s*[:#-]?\s*\d+$",
}
# Ranges of Han (with extension A and compatibility forms), kana and hangul.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{AC00}-\x{D7AF}]"
# Characters that UTF-8 shows when read as Latin-1.
MOJIBAKE = r"[ÃÂæçåéðï¤¦¥\x{81}\x{9c}]"
# Placeholders that a translation must keep.
PLACEHOLDERS = (r"%(?:\d+\$)?[-+#0-9.*]*[sdifuxXcfeEgGaApn%]", r"\{(?:\d+|[A-Za-z_]\w*)\}", r"\\[nrt]", r"<[^>\n]{1,40}>")
# Ordered log rules: token, severity, category; then groups of words.
LOG_RULES = (
    ("OutOfMemoryError", "HIGH", "memory"), ("VerifyError", "HIGH", "class"), ("ClassFormatError", "HIGH", "class"),
    ("NoClassDefFoundError", "HIGH", "class"), ("ClassNotFoundException", "HIGH", "class"),
    ("UnsupportedEncodingException", "HIGH", "encoding"), ("MalformedInputException", "HIGH", "encoding"),
    ("UnmappableCharacterException", "HIGH", "encoding"), ("IllegalArgumentException", "MEDIUM", "runtime"),
    ("ArrayIndexOutOfBoundsException", "HIGH", "binary"), ("IndexOutOfBoundsException", "HIGH", "binary"),
    ("NullPointerException", "HIGH", "runtime"), ("IOException", "MEDIUM", "resource"), ("EOFException", "HIGH", "binary"),
    ("ZipException", "HIGH", "archive"), ("SecurityException", "HIGH", "signature"), ("Exception", "MEDIUM", "runtime"),
    ("Error", "MEDIUM", "runtime"),
)
FAILURE_WORDS = ("fatal", "crash", "failed to load", "could not load", "uncaught")
WARNING_WORDS = ("warning", "warn:", "[warn]")
# Error types of the log correlation, in order; the first four kinds listed here are severe.
ERROR_TYPES = ("ClassNotFoundException", "NoClassDefFoundError", "UnsupportedOperationException", "VerifyError", "SecurityException", "OutOfMemoryError", "NullPointerException", "IllegalArgumentException")
SEVERE_TYPES = ("ClassNotFoundException", "NoClassDefFoundError", "VerifyError", "OutOfMemoryError")
STACK_FRAME = r"^\s*at\s+([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+)\.[^.(\s]+\s*\("
# Classes and resources that a log line names.
CLASS_IN_LOG = r"(?:at\s+)?([A-Za-z_$][\w$]*(?:[./][A-Za-z_$][\w$]*)+)(?:\.[A-Za-z_$][\w$]*)?\s*\("
RESOURCE_IN_LOG = r"(?i)([A-Za-z0-9_./\\-]+\.(?:class|dat|bin|res|properties|txt|xml|png|fnt|jar))"
PLATFORM_PREFIXES = ("java.", "javax.", "sun.", "com.sun.")
# API hints of package prefixes, first hit counts.
API_HINTS = (
    ("javax.wireless.messaging", "wma_sms"), ("javax.microedition.m3g", "m3g"), ("javax.bluetooth", "bluetooth"),
    ("javax.microedition.io.file", "file_connection"), ("javax.microedition.media", "media"), ("com.nokia", "nokia"),
    ("com.samsung", "samsung"), ("com.siemens", "siemens"), ("com.sonyericsson", "sonyericsson"), ("com.motorola", "motorola"),
)
# Byte signatures of APIs, and what each costs a report's score.
API_SIGNATURES = {
    "wma_sms": ("javax/wireless/messaging/", "javax.wireless.messaging.", "MessageConnection", "TextMessage", "BinaryMessage", "sms://"),
    "m3g": ("javax/microedition/m3g/", "javax.microedition.m3g."),
    "bluetooth": ("javax/bluetooth/", "javax.bluetooth."),
    "media": ("javax/microedition/media/", "javax.microedition.media."),
    "file_connection": ("javax/microedition/io/file/", "javax.microedition.io.file."),
    "nokia": ("com/nokia/", "com.nokia."),
    "samsung": ("com/samsung/", "com.samsung."),
    "siemens": ("com/siemens/", "com.siemens."),
    "sonyericsson": ("com/sonyericsson/", "com.sonyericsson."),
    "motorola": ("com/motorola/", "com.motorola."),
}
API_COST = {"wma_sms": 25, "nokia": 18, "samsung": 18, "siemens": 18, "sonyericsson": 18, "motorola": 18, "m3g": 8, "bluetooth": 8, "file_connection": 8, "media": 3}
# Support of APIs by target profile.
PROFILES = {
    "generic_j2me": {"native": ("media",), "conditional": ("m3g", "bluetooth", "file_connection", "wma_sms"), "unsupported": ("nokia", "samsung", "siemens", "sonyericsson", "motorola")},
    "freej2me_rg35xx": {"native": ("media",), "conditional": ("m3g", "file_connection", "bluetooth"), "unsupported": ("wma_sms", "nokia", "samsung", "siemens", "sonyericsson", "motorola")},
}
# Ranks of startup classifications; others count 1.
STARTUP_RANK = {"compatible_or_unknown": 0, "needs_runtime_test": 1, "optional_feature_risk": 2, "runtime_only_incompatibility": 2, "likely_startup_blocker": 3}
# Kinds of files by extension.
TEXT_EXTENSIONS = ("txt", "properties", "xml", "csv", "ini", "lang", "lng", "json", "yaml", "yml", "cfg", "conf", "config", "loc", "locale", "strings", "po")
BINARY_EXTENSIONS = ("dat", "bin", "res", "pak", "db", "rms")
SKIPPED_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "ico", "mp3", "wav", "mid", "midi", "amr", "ogg", "aac", "mp4", "3gp", "avi", "m4a", "zip", "jar", "gz", "bz2", "7z", "rar", "dll", "so", "exe", "dex")
MOST_READ, MOST_DEEP = 16 * 1024 * 1024, 12 * 1024 * 1024
# Hints of activation and payment in names, in ASCII content and in Chinese content.
FLOW_NAMES = ("activate", "activation", "active", "register", "registration", "license", "licence", "unlock", "payment", "billing", "purchase", "pay", "subscribe", "subscription", "sms", "fee", "charge", "premium")
FLOW_TERMS = ("activate", "activation", "register", "registration", "license", "licence", "unlock", "payment", "billing", "purchase", "subscribe", "subscription", "premium", "charge", "send sms", "sms://", "messageconnection")
FLOW_CJK = ("激活", "注册", "购买", "付费", "收费", "短信", "订购", "支付", "解锁", "授权")
CLASS_NAMES = ("activate", "activation", "register", "registration", "license", "licence", "unlock", "pay", "payment", "billing", "purchase", "subscribe", "subscription", "sms", "premium", "charge")
PAYMENT_NAMES = ("pay", "payment", "billing", "purchase", "subscribe", "subscription", "premium", "charge")
ACTIVATION_TERMS = ("activate", "activation", "register", "registration", "license", "licence", "unlock", "激活", "注册", "解锁", "授权")
PAYMENT_TERMS = ("payment", "billing", "purchase", "pay", "subscribe", "subscription", "premium", "charge", "购买", "付费", "收费", "订购", "支付")
# Evidence of fonts.
FONT_NAMES = ("font", "fonts", "glyph", "glyphs", "charset", "char", "chars", "fnt", "bitmapfont", "spritefont", "textfont")
FONT_EXTENSIONS, IMAGE_EXTENSIONS = ("fnt", "ttf", "otf", "bdf", "fon"), ("png", "gif", "jpg", "jpeg", "bmp")
# Labels of APIs.
API_LABELS = {"wma_sms": "JSR-120/205 WMA", "m3g": "JSR-184 M3G", "bluetooth": "JSR-82 Bluetooth", "file_connection": "JSR-75 FileConnection", "media": "JSR-135 MMAPI", "nokia": "Nokia proprietary API", "samsung": "Samsung proprietary API", "siemens": "Siemens proprietary API", "sonyericsson": "Sony Ericsson proprietary API", "motorola": "Motorola proprietary API"}
# Letters that a font needs where no translation says what it needs.
VIETNAMESE = (
    "ăâđêôơưĂÂĐÊÔƠƯáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
    "ÁÀẢÃẠẤẦẨẪẬẮẰẲẴẶÉÈẺẼẸẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌỐỒỔỖỘỚỜỞỠỢÚÙỦŨỤỨỪỬỮỰÝỲỶỸỴ"
)
# Titles of startup classifications and of recommended actions.
STARTUP_TITLES = {
    "likely_startup_blocker": "Likely startup blocker",
    "optional_feature_risk": "Optional feature risk",
    "runtime_only_incompatibility": "Runtime-only incompatibility",
    "needs_runtime_test": "Needs runtime test",
    "compatible_or_unknown": "Không thấy blocker startup rõ ràng",
    "startup_path": "Kiểm tra class trên startup path",
    "unsupported_api": "Kiểm tra API chưa được target runtime hỗ trợ",
    "suspicious_class": "Kiểm tra class nghi vấn",
    "conditional_api": "Kiểm thử API conditional trực tiếp trên RG35XX",
    "runtime_test": "Chạy kiểm thử thực tế trên FreeJ2ME / RG35XX",
}
# Markers of a declared encoding, and the extensions in which they are looked for.
ENCODING_MARKERS = ("utf-8", "utf8", "unicode", "charset", "glyph")
MARKED_EXTENSIONS = ("txt", "properties", "xml", "ini", "cfg", "json", "csv", "lang", "lng", "dat", "bin", "res")
# Kinds of entries by extension, in order.
ENTRY_KINDS = (("jar", ("jar",)), ("class", ("class",)), ("text", ("properties", "txt", "xml", "ini", "lang", "lng", "json", "yaml", "yml", "csv")), ("binary", ("dat", "bin", "res", "map", "sce")), ("image", ("png", "jpg", "jpeg", "gif", "bmp")), ("audio", ("mid", "midi", "wav", "mp3", "amr")))
