"""Closed domains and wire values. All of these are fixed values of the data contract."""

from __future__ import annotations

# Categories, best first.
CATEGORIES = ["人名", "社名", "商標", "連絡先", "地名", "その他"]
PLAIN = ["地名", "その他"]  # not special: never raise confidence, never promoted
CONFIDENCE_RANK = {"確定": 4, "強": 3, "中": 2, "弱": 1, "微弱": 0, "除外": -1}
CONFIDENCE_WIRE = {"確定": "certain", "強": "strong", "中": "medium", "弱": "weak", "微弱": "faint", "除外": "excluded"}
AUTO_MASK = ["確定", "強"]
PLACEHOLDER_PREFIX = {"人名": "人物", "社名": "社", "商標": "商標", "地名": "地名", "連絡先": "連絡先", "その他": "語"}

# Votes to categories.
NER_CATEGORY = {"PERSON": "人名", "COMPANY": "社名", "COMPANY_GROUP": "社名", "CITY": "地名", "PROVINCE": "地名", "COUNTRY": "地名"}
LLM_CATEGORY = {
    "Person": "人名",
    "Company": "社名",
    "Department": "社名",
    "Province": "地名",
    "City": "地名",
    "Country": "地名",
    "Address": "地名",
    "Facility": "地名",
    "Email": "連絡先",
    "Phone_Number": "連絡先",
    "Trademark": "商標",
    "Employee_ID": "その他",
    "Account": "その他",
    "IP_Address": "その他",
}
LLM_IDENTIFIERS = ["Employee_ID", "Account", "IP_Address"]
POS_CATEGORY = {"名詞-固有名詞-人名": "人名", "名詞-固有名詞-地名": "地名", "名詞-固有名詞-一般": "その他"}
DECISIVE = ["dict", "session", "regex"]  # channels outside the two systems
ANCHORS = ["dict", "session"]
CHANNEL_ORDER = {"dict": 0, "dict_cjk": 1, "dict_partial": 2, "session": 3, "sudachi": 4, "llm": 9}  # models stand between
MAX_RUN = 12  # tokens or atoms in a dictionary match

# Shapes.
EMAIL = r"[a-zA-Z0-9.!#$%&'*+/=?^_`{}~-]+@(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}"
CODE_MARKER = r"[_@~\[\]{}=!<>;|\\]|::"
NAME_CHAR = r"[A-Za-z぀-ヿ㐀-鿿]"
KANJI = r"^[㐀-鿿]"
ASCII_DIGIT_CODE = r"^[\x21-\x7e]*[0-9][\x21-\x7e]*$"
CJK_SEPARATORS = "・･「」『』（）〔〕【】〈〉《》｢｣"
DANGLING = r"^[-‐‑–—―・･.．]|[-‐‑–—―・･.．]$"
EDGE_QUOTES = "\"'`＂｀“”‘’„‟〝〞«»"
OPEN_PARENS, CLOSE_PARENS = "(（", ")）"
JP_LETTER = r"[ぁ-ゖァ-ヺー㐀-䶿一-鿿]"
SEPARATORS = "・･/／,，、　 \t×"
SUBWORD = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
BRACKET_OPEN, BRACKET_CLOSE = "([{（［｛〔【", ")]}）］｝〕】"
CELL_JOINER, ROW_END = "、", "。"
CHUNK_SEPARATOR = "\n\n"

VOTE = "channel string, label string"
SPAN = "start int, end int"
