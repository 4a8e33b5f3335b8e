"""Word lists, patterns and thresholds that results depend on."""

# --- web addresses, in the order they are removed
WEB = (
    r"\[[^\]]*\]\([^)]*\)",
    r"(?i)<a\s[^>\n\r]*>.*?</a>",
    r"(?i)\bhttps?://\S+",
    r"(?i)\bwww\.\S+",
    r"(?i)\b[a-z0-9-]+\.(?:com|net|org|io|co|ai|dev|info|biz|me|us|uk|in)\b(?:/\S*)?",
    r"\[[^\]]*\]\s*\(\s*\)",
    r"\(\s*\)",
)

# --- canonical keys: colloquial wordings and what they become, in order
WORDINGS = (
    (r"(?i)\bwon'?t turn on\b", "does not power on"),
    (r"(?i)\bwont power up\b", "does not power on"),
    (r"(?i)\bdoesn'?t turn on\b", "does not power on"),
    (r"(?i)\bkeeps? (?:going|turning) (?:black|blank|off)\b", "displays blank screen"),
    (r"(?i)\bgoes? (?:completely )?(?:black|blank)\b", "displays blank screen"),
    (r"(?i)\bblack screen\b", "blank display"),
    (r"(?i)\bscreen is dead\b", "blank display"),
    (r"(?i)\bnothing (?:shows|appears|displays)\b", "displays blank screen"),
    (r"(?i)\bflickers?\b", "flickering display"),
    (r"(?i)\bblinks?\b", "flickering display"),
    (r"(?i)\bdies (?:so )?fast\b", "drains rapidly"),
    (r"(?i)\bdrain(?:s|ing)? (?:really |so |very )?(?:fast|quick(?:ly)?)\b", "drains rapidly"),
    (r"(?i)\bruns? out of (?:charge|battery)\b", "drains rapidly"),
    (r"(?i)\b(?:really |very |so )?(?:slow|laggy|sluggish)\b", "degraded performance"),
    (r"(?i)\bfreez(?:es|ing)\b", "degraded performance"),
    (r"(?i)\bhangs?\b", "degraded performance"),
    (r"(?i)\btouch (?:isn'?t|is not) working\b", "unresponsive touchscreen"),
    (r"(?i)\bnot responding to touch\b", "unresponsive touchscreen"),
    (r"(?i)\bcracked\b", "physically damaged screen"),
    (r"(?i)\bbroken screen\b", "physically damaged screen"),
    (r"(?i)\bcan'?t see anything\b", "blank display"),
    (r"(?i)\bwhite screen\b", "blank display"),
    (r"(?i)\bhalf (?:the )?screen\b", "partial display failure"),
)
MODELS = r"(?i)\b(?:techcorp|nexa|galaxy|samsung|fold|flip|ultra|plus|pro|lite|tab(?:let)?|smart ?phone|phone|device|mobile|[a-z]\d{1,3}[a-z]?g?)\b"
NOISE = r"(?i)\b(?:my|the|a|an|i|i'?m|im|on|of|to|in|is|are|it|its|this|that|and|or|so|but|please|help|hi|hello|thanks?)\b"
GENERIC = (
    "went", "going", "goes", "keeps", "kept", "completely", "totally", "really", "very", "suddenly", "randomly",
    "constantly", "always", "never", "still", "just", "now", "cannot", "cant", "can", "wont", "want", "does",
    "doesnt", "didnt", "isnt", "arent", "been", "being", "have", "has", "had", "get", "gets", "got", "getting",
    "something", "anything", "nothing", "everything", "sometimes", "even", "much", "when", "while", "after",
    "before", "with", "without", "from", "into", "than", "about", "over", "there", "their", "then", "they",
    "them", "what", "which", "any", "all", "out", "off", "for", "but", "not", "one", "seems", "seem", "like",
    "try", "tried", "trying", "able", "unable", "problem", "issue", "help",
)

# --- variations of a complaint
TYPOS = (("screen", "scren"), ("display", "dispaly"), ("battery", "bettery"), ("phone", "phne"), ("settings", "setings"), ("black", "blak"), ("touch", "tuch"), ("flicker", "flikker"), ("charging", "chargin"))
OPENS_WITH_VERB = r"(?i)^(?:is|are|was|were|has|have|goes|go|keeps?|stays?|turns?|shows?|flickers?|drains?|freezes?|crashes?|stops?|won'?t|doesn'?t|does|can'?t|cannot|fails?|displays?|responds?)\b"
KEYWORD_STOPS = (
    "my", "the", "a", "an", "and", "or", "to", "of", "in", "on", "is", "are", "it", "its", "i", "so", "that",
    "this", "when", "with", "for", "but", "then", "after", "before",
)
OWN_DEVICE = r"(?i)\bmy\s+(?:techcorp\s+)?(?:nexa\s+)?(?:[a-z]\d{1,3}[a-z]?g?\s+)?(?:fold\s+)?(?:smart ?phone|phone|tablet|device|screen)\b"
# what stands before the complaint, before it if it opens with no verb, and behind it
PARAPHRASES = (
    ("The device is experiencing ", "", "."),
    ("My phone ", "has ", "."),
    ("Why does my phone ", "have ", "?"),
    ("How do I fix ", "", " on my phone?"),
    ("This is so annoying - ", "", " and nothing I try works."),
    ("Hey so my phone ", "keeps having ", ", any ideas?"),
    ("Ever since yesterday my phone ", "has ", "."),
)
SPARES = (("Need help with ", "."), ("", " - what should I do?"), ("Device issue: ", "."), ("Phone problem - ", "."))
VARIATIONS = (8, 10)

# --- titles, action names, descriptions, topics
STOPWORDS = (
    "a", "an", "the", "on", "in", "at", "of", "for", "to", "and", "or", "your", "my", "with", "from", "is", "are",
    "was", "were", "this", "that", "it", "its", "does", "do", "did", "not", "no", "some", "things", "thing",
    "first", "use", "using", "when", "while", "how", "what", "you", "smartphone", "tablet", "phone", "device",
    "mobile", "issues", "issue", "problem", "problems", "nexa", "techcorp", "galaxy", "fold", "flip", "ultra",
    "plus", "pro", "lite", "went", "goes", "going", "gone", "keeps", "kept", "completely", "totally", "suddenly",
    "randomly", "constantly", "really", "very", "so", "just", "still", "can", "cant", "cannot", "wont", "doesn",
    "didn", "isn", "see", "seeing", "anything", "nothing", "something", "everything", "interact", "trying", "try",
    "then", "than", "also", "now", "after", "before", "because", "but", "if", "again", "i", "me", "we", "am",
    "be", "been", "have", "has", "had", "get",
)
MODEL_CODE = r"(?i)^(?:[a-z]\d{1,3}[a-z]?|\d+)$"
BRANDS = (
    "techcorp", "nexa", "samsung", "galaxy", "fold", "flip", "ultra", "plus", "pro", "lite", "tab", "tablet",
    "smartphone", "phone", "device", "mobile",
)
MINOR = (
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "at", "by",
)
PROPER = {"wi-fi": "Wi-Fi", "wifi": "Wi-Fi", "bluetooth": "Bluetooth", "nfc": "NFC", "gps": "GPS", "sim": "SIM", "usb": "USB", "led": "LED", "ldi": "LDI", "techcorp": "TechCorp", "nexa": "Nexa", "android": "Android", "gmail": "Gmail", "dex": "DeX", "qr": "QR"}
FUNCTION_WORDS = (
    "the", "a", "an", "to", "for", "on", "in", "of", "with", "your", "this", "from", "off", "up", "out", "at",
)
LEAD_VERBS = (
    "check", "charge", "attempt", "force", "verify", "review", "clear", "use", "open", "select", "remove",
    "restart", "reboot", "adjust", "enable", "disable", "test", "transfer", "create", "mirror", "access",
    "disconnect", "connect", "troubleshoot", "configure", "set", "reset", "update", "install", "uninstall",
    "turn", "switch", "change", "confirm", "inspect", "examine", "clean", "replace", "contact", "visit", "try",
    "perform", "run", "start", "stop", "delete", "backup", "restore", "scan", "close", "exit", "hold", "press",
    "tap", "swipe", "navigate",
)
GOAL = r"^Follow these steps to perform this .+ (Troubleshooting|Configuration)$"
GENERIC_TITLE = r"(?i)^(some things|things to check|before you (?:begin|start)|overview|introduction|getting started)"

# --- steps of an article
HEADING = r"^(#{1,4})\s*(.+?)\s*$"
IMPERATIVE = r"(?i)^(navigate|go|open|tap|touch|select|choose|press|hold|swipe|scroll|turn|switch|toggle|enable|disable|check|verify|confirm|ensure|insert|remove|connect|disconnect|plug|unplug|charge|restart|reboot|power|clear|delete|uninstall|install|update|download|contact|visit|call|try|attempt|shine|examine|inspect|wait|drag|move|adjust|set|add|back up|sign|log|restore|reset|force|close|exit|return|repeat|locate|find|look|place|put|enter|type|scan|point)\b"
NARRATION = r"(?i)^(this|that|if|when|the|your|you(?:'|’)?ll|you will|it|these|those|there|here(?:'|’)?s|here is|remember|note|please note|for example|in such|sometimes|normally|once)\b"
LINK_DEPENDENT = r"(?i)\b(?:at the (?:provided|following|below) links?|see the links? below|refer to the links?|click (?:here|the link)|visit the links?|using the links? (?:above|below)|from the links? (?:above|below))\b"
SEQUENCE_WORD = r"(?i)^(?:first|next|now|finally|also|alternatively|afterwards?|lastly|additionally)[,\s]+"
LEADING_CLAUSE = r"(?i)^(?:after|before|once|when|while|if)\b[^,]{0,48},\s*"
POLITENESS = r"(?i)^(?:please|kindly|try to|make sure to|be sure to|you (?:should|can|may|will need to))\s+"
TOGETHER = r"(?i)^(?:let(?:'|’)?s|we(?:'|’)?ll)\s+(?:try to\s+|now\s+)?"
PRONOUN_OBJECT = r"(?i)\b(it|them|this|that|these|those|here|there|again)\b[.!]?$"
STEP_WORDS = (2, 34)
SCREEN_ENTRY = r"(?i)^(?:navigate to|go to|open)\s+(?:and open\s+)?settings\b|^(?i)swipe down from the top"
CRITICAL = r"(?i)\b(factory(?:\s+\w+)?\s+reset|reset\s+(?:your\s+)?(?:\w+\s+)?(?:phone|device|tablet|settings)|erase all|erase (?:your )?data|delete all data|safe mode|restart|reboot|power (?:off|cycle)|force a? ?restart|remove the battery|firmware|software update|wipe|format|recovery mode|hard reset)\b"
PHYSICAL = (
    r"\bservice cent(?:er|re)\b", r"\bauthori[sz]ed\b", r"\btechnician\b", r"\bwarranty\b", r"\bappointment\b",
    r"\bcontact (?:customer )?(?:support|care|us)\b", r"\bphysical damage\b", r"\bliquid\b", r"\bldi\b", r"\bcrack(?:s|ed)?\b",
    r"\bdent(?:s|ed)?\b", r"\bcharging port\b", r"\bcharger\b", r"\bcable\b", r"\busb\b", r"\bplug\b", r"\bunplug\b",
    r"\bremove [^.]{0,24}(?:case|cover|accessor|protector)", r"\b(?:soft|dry|damp) cloth\b", r"\bclean\b",
    r"\bsim (?:card|tray)\b", r"\bejector\b", r"\bpersonal computer\b", r"\bon a pc\b", r"\banother (?:phone|device)\b",
    r"\bpress and hold\b", r"\bside button\b", r"\bvolume (?:up|down) (?:key|button)\b",
)
ON_SCREEN = (
    r"\btaps?\b", r"\bswipes?\b", r"\btoggle\b", r"\bnavigate to\b", r"\bselect\b", r"\bsettings\b", r"\bopen\b",
    r"\bscroll\b", r"\bmenu\b", r"\bicon\b", r"\bpanel\b", r"\bscreen\b", r"\benable\b", r"\bdisable\b", r"\bswitch\b",
    r"\bslider\b", r"\bcheckbox\b", r"\bapps? screen\b", r"\bhome screen\b", r"\btouch\b",
)
CATEGORY_ORDER = {"auto": 0, "manual": 1, "critical": 2}

# --- retrieval
K1, B, ALPHA, BUCKETS, GRAMS, WIDEN = 1.5, 0.75, 0.6, 512, (3, 4), 40
SEARCH_STOPS = (
    "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "your", "you", "is", "are", "it", "its", "this",
    "that", "with", "from", "at", "by", "be", "will", "can", "page", "screen", "device", "settings", "setting",
    "opens", "open",
)
FRAGMENT = r"(?i)^(?:and|or|to|into|from|next|then|with|for|the|a|an|at|of|on|in)\b"
GENERIC_CONTROLS = (
    "add", "edit", "remove", "next", "done", "ok", "okay", "close", "cancel", "back", "start", "stop", "input",
    "minus", "plus", "more", "menu", "x", "yes", "no", "delete", "save", "apply", "select", "confirm", "continue",
    "finish",
)
NAME_VERBS = r"(?i)^(?:(?:view|open|enable|disable|adjust|update|switch|set|turn|check|go|see|tap|change|choose)\s+){0,4}"
COVERAGE, DENSE, MESSAGE = 0.55, 0.33, 0.6
WANTED, OPENED, OPPOSED = 0.12, 0.04, -0.08
TURNS_OFF = r"\b(turn off|switch off|disable|deactivate|uncheck|untick|remove|delete|clear)\b"
TURNS_ON = r"\b(turn on|switch on|enable|activate|check|tick|select|back up|allow)\b"
ON_SETTINGS = r"\bsettings\b|\bquick settings\b|\bnotification panel\b"
OFF_SCREEN = r"(?i)service cent(er|re)|customer support|call|visit|insert the ejector|press and hold (the )?power"
CHAIN = r"(?i)settings\s*(?:>|→|›)\s*([^.]+)"
DESTINATION = r"(?i)\b(tap(?:\s+on)?|select|choose|toggle|switch|touch(?:\s+and\s+hold)?|turn\s+(?:on|off)|enable|disable|go\s+to|navigate\s+to(?:\s+and\s+open)?|open|adjust|move|drag)\s+(.+?)(?:\s*[,.]|\s+(?:and\s+then|then|to|so|until|for|if|which|that)\b|$)"
FILLER_NOUNS = r"(?i)\b(the|your|a|an|icon|button|option|menu|slider|switch|app|page|screen)\b"

# --- kept plans and metrics
FUZZY, CONTAINED, CONTAINED_TOKENS, LIFETIME_S, KEPT = 0.62, 0.8, 3, 3600, 2000
SAMPLES_KEPT, BUDGET_MS = 5000, 300.0
SCHEME = "voiceassist://"

# --- notes shown with an action, by category
NOTES = {
    "auto": "This opens directly in your device settings — use the button below to jump straight there.",
    "manual": "This step happens away from the screen, so there's nothing for the device to open — follow the wording exactly.",
    "critical": "This action is more disruptive, so it's deliberately saved for last. Only do this if the steps above didn't help.",
}
SNAPSHOT = 1000
