"""Fixed values of the event-time rules: words, patterns, scores. Java syntax; flags i (case) and U (Unicode classes)."""

# --- fixed values: month names, hints, markers -----------------------------------------------------------------
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH = (
    "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|"
    "sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
YEAR = r"(?:19\d{2}|20\d{2})"
FULL_WIDTH = "０１２３４５６７８９／－：，．～（）　"
HALF_WIDTH = "0123456789/-:,.~() "
FUTURE = "(?iU)将于|将会|即将|计划于|预计|拟于|to be held|will|upcoming|is set to|next"
PAST = "(?iU)此前|去年|上月|昨日|昨天|last|previous|ago|earlier"
DEADLINE = r"(?iU)\b(?:by|until|till|before|through)\b|截至|到|至"
BEGINNING = r"(?iU)\b(?:from|since|starting|start)\b|自|从"
YEAR_CONTEXT = r"(?iU)\b(?:in|by|during|since|from|until|before|after|fiscal|fy|season|for|to)\b|于|在|截至|到|自|至"
MONEY = r"(?iU)[$¥￥€£₹]|USD|CNY|RMB|HKD|S\$|元|万元|亿元|万亿|美元|欧元|英镑|港元|million|billion|trillion"
PERCENT = r"(?U)\d+(?:\s*[.,]\s*\d+)?\s*%"
OUTLETS = "(?iU)DW|Reuters|Xinhua|BBC|AP|AFP|新华网|中新社|路透|彭博"
OUTLET_BEFORE_DASH = r"(?iU)(?:DW|Reuters|Xinhua|BBC|AP|AFP)\s*[-–—]\s*$"
MONTH_AFTER_WORD = rf"(?iU)\b(?:in|during|for|by|this|last|next|on)\s+({MONTH})\b"
YEAR_AFTER_WORD = rf"(?iU)\b(?:in|by|during|since|from|until|fiscal|fy|for)\s+({YEAR})(?:/\d{{2,4}})?\b"
SINGLE_ZH_MONTH = r"(?U)(?<!\d)(\d{1,2})月(?!\d)"
QUARTER_OR_HALF = (
    rf"(?iU)Q[1-4]|{YEAR}\s*Q[1-4]|第?[一二三四1-4]季度|前[一二三四1-4]季度|上半年|下半年|前\d{{1,2}}月|\d{{1,2}}\s*[-~到至]\s*\d{{1,2}}月|"
    rf"H[12]\s+{YEAR}|(?:first|second)\s+half(?:\s+of)?\s+{YEAR}"
)
DATE_SIGNAL = (
    r"(?iU)\d{4}[年/\-.]\d{1,2}(?:[月/\-.]\d{1,2})?|\d{1,2}月\d{1,2}[日号]?|"
    rf"\b{MONTH}\b|今天|今日|昨天|昨日|昨晚|明天|明日|后天|今年|去年|明年|上周|下周|本周|上月|下月|本月|上半年|下半年|前[一二三四1-4]季度|前\d{{1,2}}月|"
    r"today|yesterday|tomorrow|last|next|this\s+(?:week|month|year)"
)
PRIOR_SIGNAL = rf"(?iU){YEAR}|\d{{1,2}}月|Q[1-4]|{MONTH}|上半年|下半年"

# --- fixed values: spans of time; groups as named in SPANS ------------------------------------------------------
_ZH_YEAR = rf"(?U)(?:({YEAR})年)?"
SPANS = {
    "month_span": _ZH_YEAR + r"(\d{1,2})\s*[-~到至]\s*(\d{1,2})月",
    "month_prefix": _ZH_YEAR + r"前(\d{1,2})月",
    "quarter_prefix": _ZH_YEAR + r"前([一二三四1-4])季度",
    "quarter_zh": _ZH_YEAR + r"第?([一二三四1-4])季度",
    "quarter_en": rf"(?iU)\bQ([1-4])\s*(?:FY)?\s*({YEAR})\b",
    "quarter_year_first": rf"(?iU)\b({YEAR})\s*Q([1-4])\b",
    "half_zh": _ZH_YEAR + "([上下])半年",
    "half_en": rf"(?iU)\bH([12])\s+({YEAR})\b",
    "half_words": rf"(?iU)\b(first|second)\s+half(?:\s+of)?\s+({YEAR})\b",
}
YEARS = rf"(?U)(?<!\d)({YEAR})\s*(?:/|-|~|到|至)\s*(\d{{2,4}})(?!\d)"
NUMERIC_DMY = rf"(?U)\b(\d{{1,2}})\s*[-/.]\s*(\d{{1,2}})\s*[-/.]\s*({YEAR})\b"
EN_DMY = rf"(?iU)\b(?:mon|tue|wed|thu|fri|sat|sun)?\.?\s*(\d{{1,2}})\s+({MONTH})\s+({YEAR})\b"
EN_MDY = rf"(?iU)\b(?:on|in)?\s*({MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,\s*({YEAR}))?\b"
ZH_MD = r"(?U)(?:(\d{4})年)?(\d{1,2})月(\d{1,2})[日号]?"
ZH_YM = rf"(?U)({YEAR})年(\d{{1,2}})月(?!\d{{1,2}}[日号]?)"
EN_MY = rf"(?iU)\b({MONTH})\s+({YEAR})\b"
EN_MY_WITH_DAY = rf"(?iU)\b{MONTH}\s+\d{{1,2}},?\s+{YEAR}\b"
FULL_DATE = r"(?U)\d{4}年\d{1,2}月\d{1,2}[日号]?|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"

# --- fixed values: candidate patterns; z and e mark those for Chinese and English titles --------------------------
CANDIDATES = (
    ("ze", r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"),
    ("ze", r"\d{4}[.]\d{1,2}[.]\d{1,2}"),
    ("ze", rf"\b\d{{1,2}}\s*[-/.]\s*\d{{1,2}}\s*[-/.]\s*{YEAR}\b"),
    ("ze", rf"\b{YEAR}\b"),
    ("z", r"\d{4}年\d{1,2}月\d{1,2}[日号]?"),
    ("z", r"\d{1,2}月\d{1,2}[日号]?"),
    ("z", r"\d{4}年\d{1,2}月"),
    ("z", r"(?<!\d)\d{1,2}月(?!\d)"),
    ("z", rf"(?:(?:于|在|截至|到|自|至)\s*)?{YEAR}年(?!\d{{1,2}}月)"),
    ("z", r"(?:今天|今日|昨天|昨日|昨晚|明天|明日|后天|今年|去年|明年|上周|下周|本周|上月|下月|本月|上半年|下半年|第?[一二三四1-4]季度|前[一二三四1-4]季度|前\d{1,2}月|\d{1,2}\s*[-~到至]\s*\d{1,2}月)"),
    ("ze", rf"\b{MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b"),
    ("ze", rf"\b\d{{1,2}}\s+{MONTH}\s+{YEAR}\b"),
    ("e", rf"\b{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?\b"),
    ("ze", rf"\b{MONTH}\s+\d{{4}}\b"),
    ("e", rf"\b(?:in|during|for|by|this|last|next|on)\s+{MONTH}\b"),
    ("e", rf"\b(?:Q[1-4]\s*(?:FY)?\s*{YEAR}|{YEAR}\s*Q[1-4])\b"),
    ("e", rf"\b(?:H[12]\s+{YEAR}|(?:first|second)\s+half(?:\s+of)?\s+{YEAR})\b"),
    ("e", rf"\b(?:in|by|during|since|from|until|fiscal|fy|for)\s+{YEAR}(?:/\d{{2,4}})?\b"),
    ("e", rf"\b{YEAR}\s*/\s*\d{{2,4}}\b"),
    ("e", r"\b(?:today|yesterday|tomorrow|last\s+\w+|next\s+\w+)\b"),
)

# --- fixed values: scores, the first pattern that fits counts -----------------------------------------------------
SCORES = (
    (60, FULL_DATE),
    (56, NUMERIC_DMY),
    (56, rf"(?iU)\b\d{{1,2}}\s+{MONTH}\s+{YEAR}\b"),
    (55, rf"(?iU)\b{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*{YEAR})?\b"),
    (28, rf"(?U)^{YEAR}$"),
    (50, r"(?U)\d{1,2}月\d{1,2}[日号]?"),
    (45, QUARTER_OR_HALF),
    (40, rf"(?iU)\d{{4}}年\d{{1,2}}月|\b{MONTH}\s+\d{{4}}\b"),
    (35, rf"{YEAR_AFTER_WORD}|(?:于|在|截至|到|自|至)\s*{YEAR}年?"),
    (30, rf"{MONTH_AFTER_WORD}|(?<!\d)\d{{1,2}}月(?!\d)"),
    (30, DATE_SIGNAL),
)

# --- fixed values: relative words and the days, months or years they move -----------------------------------------
RELATIVE_DAYS = {"today": 0, "yesterday": -1, "tomorrow": 1, "今天": 0, "今日": 0, "昨天": -1, "昨日": -1, "昨晚": -1, "前天": -2, "明天": 1, "明日": 1, "后天": 2, "本周": 0, "上周": -7, "下周": 7, "last week": -7, "next week": 7}
RELATIVE_MONTHS = {"本月": 0, "上月": -1, "下月": 1, "this month": 0, "last month": -1, "next month": 1}
RELATIVE_YEARS = {"今年": 0, "去年": -1, "明年": 1, "this year": 0, "last year": -1, "next year": 1}

# --- fixed values: numbers, weekdays and times ago or ahead, in English ----------------------------------------------
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_NUMBER = rf"(\d{{1,4}}|{'|'.join(sorted(NUMBERS, key=len, reverse=True))})"
AGO = rf"(?iU)\b{_NUMBER}\s+(day|week|month|year)s?\s+(?:ago|earlier)\b"
AHEAD = rf"(?iU)\bin\s+{_NUMBER}\s+(day|week|month|year)s?\b"
WEEKDAY = r"(?iU)\b(?:(last|next|this)\s+)?((?:mon|tues|wednes|thurs|fri|satur|sun)day)\b"
RELATIVE = r"(?iU)\b(?:ago|earlier|in)\b|day\b"

# --- fixed values: what a title must hold to hold a candidate --------------------------------------------------------
MAY_HOLD = r"(?iU)\d|[年月周天日季晚]|半年|day|morrow|last|next|\bin\b|\bduring\b|\bfor\b|\bby\b|\bthis\b|\bon\b|half"

# --- fixed values: month names of tier 2, by language --------------------------------------------------------------
MONTHS_ABROAD = {
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "ru": ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"),
    "uk": ("січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня"),
    "sw": ("januari", "februari", "machi", "aprili", "mei", "juni", "julai", "agosti", "septemba", "oktoba", "novemba", "desemba"),
}
