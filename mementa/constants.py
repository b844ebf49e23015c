"""The vocabularies and limits the results depend on."""

# Media extensions per gallery category.
PHOTO_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "bmp", "webp", "heic", "heif", "tif", "tiff",
    "dng", "raw", "cr2", "nef", "arw", "rw2", "orf", "svg",
]
VIDEO_EXTENSIONS = [
    "mp4", "mov", "m4v", "mkv", "avi", "webm", "3gp", "3gpp", "mpg", "mpeg",
    "wmv", "flv", "ts", "m2ts",
]
MUSIC_EXTENSIONS = [
    "mp3", "m4a", "aac", "flac", "wav", "ogg", "oga", "opus", "wma", "amr",
    "aiff", "aif", "mid", "midi",
]
DOCUMENT_EXTENSIONS = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "odt",
    "ods", "odp", "csv", "md", "epub", "pages", "numbers", "key",
]
# Category order used by every metrics report.
CATEGORIES = ["photo", "video", "music", "documents"]
CATEGORY_LABELS = {
    "photo": "Photos",
    "video": "Videos",
    "music": "Music",
    "documents": "Documents",
    "other": "Other",
}
# Photo formats a browser cannot show, and formats decoded directly.
NON_WEB_PHOTO_EXTENSIONS = [
    "heic", "heif", "tif", "tiff", "dng", "raw", "cr2", "nef", "arw", "rw2", "orf",
]
DECODABLE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff"]

# Media folders of a category sync and messenger folder mapping.
SYNC_CATEGORIES = ["Photo", "Video", "Music", "Documents"]
MESSENGER_MEDIA_MAPPING = [
    ("WhatsApp Images", "Photo"),
    ("WhatsApp Video", "Video"),
    ("WhatsApp Video Notes", "Video"),
    ("WhatsApp Audio", "Music"),
    ("WhatsApp Voice Notes", "Music"),
]

# Device media folders and message database folders, in preference order.
DEVICE_MEDIA_FOLDERS = [
    ("DCIM", "/sdcard/DCIM/"),
    ("Pictures", "/sdcard/Pictures/"),
    ("Download", "/sdcard/Download/"),
    ("Movies", "/sdcard/Movies/"),
    ("Music", "/sdcard/Music/"),
    ("WhatsApp Media", "/storage/emulated/0/Android/media/com.whatsapp/WhatsApp/Media/"),
]
MESSAGE_DB_FOLDERS = [
    "/storage/emulated/0/Android/media/com.whatsapp/WhatsApp/Databases",
    "/sdcard/WhatsApp/Databases",
    "/storage/emulated/0/WhatsApp/Databases",
]
PREFERRED_MESSAGE_DBS = ["msgstore.db.crypt15", "msgstore.db.crypt14"]

# The backup adapters.
ADAPTERS = [
    ("adb-generic", "Android device (ADB)",
     "Pull media directly from an authorized Android phone over USB debugging."),
    ("generic-folder", "Generic folder",
     "Use any user-selected folder as a local backup source."),
    ("samsung-smartswitch", "Samsung SmartSwitch",
     "Import media and structured inventories from a user-selected SmartSwitch backup."),
    ("google-takeout", "Google Takeout",
     "Recognize Google Takeout exports selected from the filesystem."),
]

# Folders of a structured backup with their record kind and fallback status.
STATUS_FOLDERS = [
    ("contact", "CONTACT", "encrypted_or_proprietary_payload"),
    ("calllog", "CALLLOG", "binary_or_proprietary_payload"),
    ("app", "APK", "binary_apk_payload"),
]
APP_FOLDERS = [
    ("APK", "inventory_apk_payload"),
    ("GALAXYSTORE", "inventory_app_store_payload"),
    ("DISABLEDAPPS", "inventory_disabled_apps_payload"),
]
MESSAGE_FOLDERS = ["MESSAGE", "WhatsApp"]
BROWSER_STATUS = "inventory_only_proprietary_payload"
MESSAGE_DB_STATUS = "encrypted_whatsapp_message_database"
NOTE_STATUS = "proprietary_note_payload"
CALENDAR_STATUS = "unsupported_calendar_file"

# Limits and thresholds.
HAMMING_LIMIT = 24
ASPECT_TOLERANCE = 8
LUMA_RANGE_MIN = 10
PAGE_DEFAULT = 120
PAGE_MIN, PAGE_MAX = 1, 500
GROUP_TILE_CAP = 24
MESSAGE_SAMPLE = 100
ITEM_METRICS_SHOWN = 12
SUB_SOURCES_SHOWN = 6
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"
