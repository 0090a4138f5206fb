"""Personal data in free text: candidate spans, boosted trees that judge them, typed placeholders.

Generators propose overlapping spans at high recall from form alone: every run of name-shaped words with its parts, every digit
group sequence, every mail sign, every unit word or numbered street. Boosted trees judge each by features of format and context;
context words count by their word class, whose weight is learned. Of the spans above the kind's threshold, which is calibrated on
sentence frames that the trees never saw, the likeliest that don't overlap are taken. The trees are trained on a bounded number
of labelled sentences that ``labelled_rows`` composes.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.llm import vocabulary
from vinculum.llm.trees import BoostedTrees

KINDS = ["NAME", "PHONE", "EMAIL", "ID_NUMBER", "ADDRESS"]
NAME, PHONE, EMAIL, ID_NUMBER, ADDRESS_KIND = range(5)

#: Word classes of English and Hindi (in both scripts). A word counts by its class, not by itself.
WORD_CLASSES = {
    "title": [
        "mr", "mrs", "ms", "miss", "dr", "prof", "adv", "shri", "sri", "smt", "shrimati", "kum", "kumari", "sir", "madam", "rev", "capt", "श्री", "श्रीमती", "कुमारी", "डॉ",
    ],
    "role": [
        "witness", "complainant", "accused", "co-accused", "suspect", "victim", "informant", "officer", "inspector", "constable", "sergeant", "detective", "judge", "lawyer",
        "advocate", "driver", "manager", "clerk", "cashier", "owner", "tenant", "landlord", "doctor", "nurse", "patient", "teacher", "student", "pupil", "engineer", "director",
        "chairman", "secretary", "minister", "editor", "reporter", "farmer", "shopkeeper", "vendor", "trader", "guard", "watchman", "neighbour", "neighbor", "friend",
        "colleague", "client", "customer", "employee", "employer", "applicant", "passenger", "guest", "member", "resident", "citizen", "agent", "broker", "deponent",
        "गवाह", "आरोपी", "शिकायतकर्ता", "चालक", "अधिकारी", "मालिक", "मित्र", "पीड़ित", "डॉक्टर", "शिक्षक", "दोस्त", "भाई", "बहन", "पड़ोसी",
    ],
    "kin": ["son", "daughter", "wife", "husband", "brother", "sister", "father", "mother", "uncle", "aunt", "cousin", "nephew", "niece", "s/o", "d/o", "w/o", "पुत्र", "पुत्री", "पत्नी", "पति", "बेटा"],
    "residence": ["resident", "residing", "resides", "lives", "living", "lived", "address", "aged", "age", "r/o", "निवासी", "पता", "rehta", "rehti", "rehte"],
    "determiner": [
        "a", "an", "the", "this", "these", "those", "his", "her", "their", "our", "my", "your", "its", "each", "every", "some", "any", "no", "another", "other",
        "both", "all", "few", "many", "several", "such", "same", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    ],
    "place_preposition": ["in", "at", "near", "behind", "beside", "opposite", "inside", "outside", "towards", "through", "along", "across", "under", "over", "above", "below", "around"],
    "agent_preposition": ["by", "with", "from", "to", "for", "of", "against", "about", "between", "among", "versus", "vs", "via", "regarding", "concerning"],
    "preposition": ["on", "upon", "without", "within", "after", "before", "during", "since", "until", "till", "per", "except", "off", "out", "up", "down", "into", "onto", "against", "despite", "alongside", "beyond"],
    "conjunction": ["that", "and", "or", "but", "nor", "when", "while", "where", "whether", "if", "because", "as", "than", "though", "although", "who", "whom", "whose", "which", "what", "so", "how", "why"],
    "auxiliary": ["is", "are", "was", "were", "be", "been", "being", "am", "has", "have", "had", "having", "do", "does", "did", "will", "would", "shall", "should", "may", "might", "can", "could", "must"],
    "pronoun": ["he", "she", "they", "we", "i", "you", "it", "him", "them", "me", "us", "himself", "herself", "themselves", "nobody", "somebody", "everyone", "someone", "anyone", "everybody", "there", "here"],
    "negation": ["not", "never", "neither", "nothing", "none", "only", "also", "even", "just", "still", "already", "again", "then", "now", "soon", "later", "last", "first", "next", "shortly", "finally", "however"],
    "verb": [
        "say", "says", "said", "tell", "tells", "told", "ask", "call", "calls", "meet", "meets", "met", "know", "knows", "knew", "known", "see", "saw", "seen", "speak",
        "speaks", "spoke", "write", "writes", "wrote", "send", "sends", "sent", "pay", "pays", "paid", "give", "gives", "gave", "given", "take", "took", "taken", "bring", "brought", "buy",
        "bought", "sell", "sold", "leave", "left", "come", "came", "go", "goes", "went", "gone", "get", "got", "make", "made", "find", "found", "hold", "held", "ring", "rang", "rung", "sign", "drive", "drove",
        "run", "ran", "think", "thought", "hear", "heard", "keep", "kept", "put", "show", "shown", "contact", "visit", "follow", "help", "thank", "email", "work", "works", "swear", "swore", "sworn", "reach", "lend", "lent", "owe", "owes", "accompany", "introduce", "identify", "inform",
    ],
    "time": [
        "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
        "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "today", "yesterday", "tomorrow", "morning", "evening", "night", "noon", "week", "month", "year",
        "kal", "parso", "aaj", "subah", "shaam", "raat", "din", "कल", "परसों", "आज", "सुबह", "शाम", "रात",
    ],
    "firm": [
        "ltd", "limited", "pvt", "private", "llp", "llc", "inc", "corp", "corporation", "company", "co", "sons", "brothers", "bros", "society", "cooperative", "association", "trust", "foundation", "group",
        "exports", "imports", "finance", "chemicals", "constructions", "electronics", "jewellers", "foods", "traders", "textiles", "transport", "logistics", "motors", "media", "steel", "works",
        "security", "services", "industries", "enterprises", "agency", "agencies", "stores", "hotels", "hotel", "pharma", "bank", "insurance", "college", "school", "university", "hospital", "institute", "solutions", "technologies", "systems", "builders", "bakery", "club",
    ],
    "place": [
        "nagar", "colony", "market", "layout", "enclave", "vihar", "street", "road", "lane", "marg", "avenue", "gali", "square", "bridge", "station", "outpost", "airport", "park", "garden", "gardens", "district", "village", "town", "city",
        "state", "county", "east", "west", "north", "south", "apartments", "complex", "towers", "tower", "chambers", "bhavan", "bhawan", "chowk", "junction", "ghat", "temple", "church", "mosque", "river", "lake", "hill", "hills", "fort", "beach", "island", "boulevard", "highway", "drive",
        "थाना", "नगर", "बाज़ार", "बाजार", "शहर", "गाँव", "सड़क", "चौक", "स्टेशन", "मोहल्ला",
    ],
    "unit": ["house", "flat", "flt", "fl", "shop", "shp", "plot", "plt", "godown", "gdn", "door", "apartment", "apt", "suite", "room", "office", "मकान", "फ्लैट", "दुकान"],
    "phone_cue": ["phone", "mobile", "telephone", "tel", "cell", "whatsapp", "number", "reached", "calls", "called", "calling", "call", "dial", "dialled", "ring", "rang", "rung", "contact", "sms", "फोन", "नंबर", "मोबाइल"],
    "mail_cue": ["mail", "email", "e-mail", "mails", "emails", "inbox", "ईमेल"],
    "id_cue": ["id", "passport", "licence", "license", "voter", "tax", "pan", "aadhaar", "aadhar", "document", "identity", "card", "copy", "national", "insurance", "पत्र", "पहचान", "आधार"],
    "account_cue": ["account", "a/c", "entry", "case", "file", "exhibit", "hash", "tower", "vehicle", "invoice", "order", "receipt", "memo", "serial", "tracking", "item", "batch", "model", "version", "page", "खाता", "वाहन", "टावर", "केस"],
    "money_cue": ["rs", "inr", "rupees", "usd", "dollars", "sum", "amount", "cash", "paid", "lakh", "crore", "thousand", "hundred", "paise", "राशि", "रुपये"],
    "postposition": ["ne", "ko", "se", "ka", "ki", "ke", "mein", "me", "par", "pe", "tak", "wala", "wale", "paas", "saath", "liye", "ने", "को", "से", "का", "की", "के", "में", "पर", "तक", "वाला", "वाले", "पास", "साथ", "लिए", "बीच", "द्वारा"],
    "hindi_joint": ["aur", "ya", "lekin", "magar", "ki", "ki", "jo", "jab", "tab", "और", "या", "लेकिन", "मगर", "कि", "जो", "जब", "तब", "व", "तथा", "एवं", "भी", "ही", "तो"],
    "hindi_verb": [
        "hai", "hain", "tha", "thi", "the", "ho", "hoon", "hun", "gaya", "gayi", "gaye", "kiya", "kaha", "bola", "boli", "bole", "diya", "di", "liya", "li", "raha", "rahi", "rahe", "karo", "karna", "karta", "aaya", "aayi", "bheja", "bheji", "dekha", "dekhi", "dikhayi", "mila", "mili", "band", "lo", "do", "kar",
        "है", "हैं", "था", "थी", "थे", "हो", "हूँ", "हुआ", "हुई", "हुए", "गया", "गई", "गए", "किया", "की", "कहा", "बोला", "बताया", "दिया", "दी", "लिया", "ली", "रहा", "रही", "रहे", "करें", "आया", "आई", "भेजा", "देखा", "मिला", "मिली", "खड़ा", "सकती", "सकता", "जमा", "लगी", "कर", "जा",
    ],
    "hindi_other": [
        "main", "mera", "meri", "mere", "hum", "hamara", "tum", "aap", "woh", "wo", "yeh", "ye", "uska", "uski", "unka", "unki", "iska", "naam", "nahi", "nahin", "bhai", "bhaiya", "ji", "bahut", "kuch", "koi", "sab", "yahan", "wahan", "ab", "phir", "gaadi", "paisa", "paise", "ghar", "kaam", "baat", "log", "data",
        "मैं", "मेरा", "मेरी", "हम", "हमारा", "तुम", "आप", "वह", "वे", "यह", "ये", "उसका", "उसकी", "उनका", "इसका", "नाम", "नहीं", "बहुत", "कुछ", "कोई", "सब", "यहाँ", "वहाँ", "अब", "फिर", "घर", "काम", "बात", "लोग", "समय", "घटना", "कई", "बार", "सूचना", "लिखित", "शिकायत", "बयान", "रिपोर्ट", "फाइल", "प्रति", "संदिग्ध", "गतिविधि", "सक्रिय",
    ],
}
#: Classes that a form or an ending gives to words outside the lists.
FORMS = ["past", "gerund", "adverb", "open", "capital", "rare", "upper", "initial", "devanagari", "start"]
CLASSES = [*WORD_CLASSES, *FORMS]
_NUMBER_OF = {name: k for k, name in enumerate(CLASSES)}
_CLASS_OF = {w: k for k, words in reversed(list(enumerate(WORD_CLASSES.values()))) for w in words}
_K = 64  # more than there are classes
#: Classes of words that may stand in a name's place.
_OPEN = {_NUMBER_OF[c] for c in ("role", "past", "gerund", "adverb", "open", "capital", "rare", "upper", "initial", "devanagari")}
_TITLE, _ROLE, _FIRM, _PLACE, _UNIT_CLASS, _START = (_NUMBER_OF[c] for c in ("title", "role", "firm", "place", "unit", "start"))
_CUES = ["phone_cue", "id_cue", "account_cue", "money_cue", "mail_cue"]
_CUE_AT = {_NUMBER_OF[c]: k for k, c in enumerate(_CUES)}
#: Endings of common English words.
_ENDINGS = ("ed", "ing", "ly", "tion", "ment", "ness", "able", "ible", "ous", "ful", "less", "ship", "ist", "er", "or", "ers", "ors", "ies", "es", "ts", "ns", "ss", "al", "ic", "ive", "ity", "ure", "age", "ance", "ence")

_BEYOND = 7 * _K + _START
_SHAPE = 6
NAMEY, SEMI, COMMON, ENDING = 1 << 10, 1 << 11, 1 << 12, 1 << 13
_PIECES = 14
LOWER, TITLE, UPPER, INITIAL, DEVANAGARI, MIXED = range(6)

_ASCII_WORD = re.compile(r"([A-Za-z]++(?:['\-/](?!s\b)[A-Za-z]++)*+)")
_WORD = re.compile(r"([ऀ-ॣॱ-ॿ]++|[^\W\d_]++(?:['’\-/](?!s\b)[^\W\d_]++)*+)")


class Lexicon(dict):
    """Class, shape and flags of words as typed, computed once per word and process; forgets all when it has grown large.

    A word is common if the public vocabulary holds it as one piece after a blank.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__()
        self.path, self.most = path, most

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
        low = word.lower()
        dev = "ऀ" <= low[0] <= "ॿ"
        if dev:
            shape = DEVANAGARI
        elif len(word) == 1:
            shape = INITIAL
        elif word.islower():
            shape = LOWER
        elif word.isupper():
            shape = UPPER
        else:
            shape = TITLE if word[0].isupper() and all(p[1:] == p[1:].lower() for p in re.split(r"['’\-]", word)) else MIXED
        pieces = 0 if dev else len(vocabulary.encoding(self.path).encode_ordinary(" " + low))
        common = pieces == 1
        ending = len(low) > 4 and low.endswith(_ENDINGS)
        cls = _CLASS_OF.get(low)
        listed = cls is not None and cls != _ROLE
        if shape == INITIAL:
            cls = _NUMBER_OF["initial"] if word.isupper() or cls is None else cls
            namey, semi = True, False
        else:
            namey = not listed and (len(low) >= 2 if dev else shape in (TITLE, MIXED) or len(low) >= 3 and not common)
            semi = not listed and shape == UPPER and common
            if listed and shape in (LOWER, DEVANAGARI):
                namey = False
            if cls is None:
                if dev:
                    form = "devanagari"
                elif shape == UPPER:
                    form = "upper"
                elif shape in (TITLE, MIXED):
                    form = "capital"
                else:
                    form = "past" if low.endswith("ed") else "gerund" if low.endswith("ing") else "adverb" if low.endswith("ly") else "open" if common else "rare"
                cls = _NUMBER_OF[form]
            elif cls == _ROLE and shape in (LOWER, DEVANAGARI):
                namey = False
        code = cls | shape << _SHAPE | NAMEY * namey | SEMI * semi | COMMON * common | ENDING * ending | min(pieces, 15) << _PIECES
        self[word] = code
        return code


@functools.cache
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def _separator(gap: str) -> int:
    """Kind of what stands between two words: 0 blank, 1 comma, 2 colon or dash, 3 end of a sentence or line, 4 bracket or quote, 5 digits, 6 other."""
    if gap == " ":
        return 0
    for c in gap:
        if c.isdigit():
            return 5
    for c in gap:
        if c in ".!?।\n":
            return 3
    for kind, signs in ((1, ","), (2, ":;-–—"), (4, "(\"“”'[)]")):
        for c in gap:
            if c in signs:
                return kind
    return 6


#: Spoken digits.
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
_SPOKEN_DIGIT = "|".join(DIGIT_WORDS)

_UNIT = r"(?:\b(?:house|flat|flt|shop|shp|plot|plt|godown|gdn|door|apartment|apt|suite|room)\b\.?(?:\s?no\b\.?)?|\b(?:h|d|p|fl|sh)\.?\s?no\b\.?|\#)"
#: A full stop after a short form belongs to it, unless a new sentence or nothing follows.
_DOT = r"(?:\.(?=,|\s[a-z\d])|(?!\w))"
_STREET = rf"(?:(?:street|road|raod|lane|gali|marg|avenue|drive|boulevard|square)\b|(?:strt|str|st|rd|ln|mrg|mg|avn|ave|av|blvd){_DOT})"
_BUILDING = rf"(?:(?:apartments?|complex|towers?|chambers?|bhavan|bhawan)\b|(?:appts?|apts?|compl|cplx|twrs?|chmbrs|chb|bhvn){_DOT})"
_LOCAL = rf"(?:(?:nagar|nagr|colony|market|layout|lay\s?out|l/o|enclave|vihar|vihaar)\b|(?:ngr|coly|clny|col|mkt|lyt|enclv|encl|vhr){_DOT})"
_NUMBER = r"\d+(?:\s?[-/\\]\s?(?:\d+|[a-z]))?"
_TAIL = r"(?:,\s(?P<city>[^\W\d_]+(?:-[^\W\d_]+)?)(?:,?\s-?\s?(?P<pin>\d{3}\s?\d{3})\b)?)?(?:,?\s(?:-\s)?(?P<pin2>\d{6})\b)?"
ADDRESS = re.compile(
    rf"{_UNIT}\s?{_NUMBER}\b(?:,\s[^\W\d_]+\s{_BUILDING})?(?:,\s[^\W\d_]+\s{_STREET})?(?:,\s[^\W\d_]+(?:\s[^\W\d_]+)?\s{_LOCAL})?" + _TAIL, re.I
)
#: An address without unit word: a number, then a street, with what follows.
NUMBERED = re.compile(
    rf"(?<![\w/\-]){_NUMBER},?\s(?:[^\W\d_]+\s){{1,2}}(?:{_STREET}|{_BUILDING}|{_LOCAL})(?:,\s[^\W\d_]+\s{_STREET})?(?:,\s[^\W\d_]+(?:\s[^\W\d_]+)?\s{_LOCAL})?" + _TAIL, re.I
)
_UNIT_AT = re.compile(_UNIT + r"\s?\d", re.I)
_LEADING_NUMBER = re.compile(rf"(?<![\w/\-]){_NUMBER},?\s(?:[^\W\d_]+\s){{1,2}}$", re.I)
_ID = re.compile(
    r"(?<![\w+/.\-])(?:[A-Za-z]{5}\s?\d{4}\s?[A-Za-z]|[A-Za-z]{2}[-\s]?\d{2}\s?\d{11}|[A-Za-z]{1,4}-?\d{5,15}[A-Za-z]?|[A-Za-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Za-z])(?![\w/]|[-]\d)"
)
_AT = re.compile(_UNIT + r"\s?\d", re.I)
_LEADING_NUMBER = re.compile(rf"(?<![\w/\-]){_NUMBER},?\s(?:[^\W\d_]+\s){{1,2}}$", re.I)
_ID = re.compile(
    r"(?<![\w+/.\-])(?:\d{4}([\s\-]?)\d{4}\1\d{4}|[A-Za-z]{5}\s?\d{4}\s?[A-Za-z]|[A-Za-z]{3}\d{7}|[A-Za-z]\d{7}|[A-Za-z]{2}[-\s]?\d{2}\s?\d{11}|"
    r"[A-Za-z]{1,4}-?\d{5,15}[A-Za-z]?|[A-Za-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Za-z])(?![\w/]|[-]\d)"
)
_AT = re.compile(r"@|\[at\]|\(at\)|(?<=\s)at(?=\s[\w\-]+\sdot\s)", re.I)
_USER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+-")
_DOMAIN = re.compile(r"\s?[A-Za-z0-9\-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)[A-Za-z0-9\-]+)+", re.I)
_SPOKEN = re.compile(rf"\b(?:{_SPOKEN_DIGIT})(?:[\s\-](?:{_SPOKEN_DIGIT})){{5,13}}\b", re.I)
_DIGITS = re.compile(r"\d[\d \t().\-]{6,}")
_NO_DIGITS = str.maketrans("", "", " \t().-")
_CODE_AT = re.compile(r"\d\d(?:\d\d(?:\d|\s?[A-Za-z]\b)|\s?\d\d[\s\d])")
_GROUP = re.compile(r"\d+")
_LETTER = re.compile(r"[^\W\d_]")
#: A date and nothing else but, perhaps, the hour.
_CALENDAR = re.compile(r"(?:\d{4}[-.]\d{2}[-.]\d{2}|\d{1,2}[-.]\d{1,2}[-.]\d{4})(?: \d\d?)?$")


@functools.cache
def _anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in ("house", "door", "flat", "flt", "fl.", "fl no", "shop", "shp", "sh.", "sh no", "plot", "plt", "p.", "p no", "godown", "gdn", "h.", "h no", "d.", "d no", "apartment", "apt", "suite", "room", "#"):
        a.add_word(w if w == "#" else " " + w, ("A", len(w)))
    for w in ("@", "[at]", "(at)", " at "):
        a.add_word(w, ("M", len(w)))
    for x in DIGIT_WORDS:
        for y in DIGIT_WORDS:
            a.add_word(f" {x} {y} ", ("S", len(x) + len(y) + 2))
    a.make_automaton()
    return a


_BLANKS = re.compile(r"[^\S ]")


def _level(text: str) -> str:
    """Lower-case text of equal length, every kind of blank a space."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    low = low.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\xa0", " ")
    return low if low.isascii() else _BLANKS.sub(" ", low)


class Words:
    """A text's words with their codes, places and what stands between them (``gaps[i]`` before word i)."""

    def __init__(self, text: str, lex: Lexicon):
        parts = (_ASCII_WORD if text.isascii() else _WORD).split(text)
        edges = list(itertools.accumulate(map(len, parts)))
        self.text, self.gaps, self.starts, self.ends = text, parts[::2], edges[:-1:2], edges[1::2]
        self.codes = list(map(lex.__getitem__, parts[1::2]))

    def near(self, a: int, b: int) -> tuple[int, int]:
        """Index of the last word that ends by ``a`` and of the first that begins from ``b``."""
        i = bisect.bisect_left(self.starts, a) - 1
        while i >= 0 and self.ends[i] > a:
            i -= 1
        return i, bisect.bisect_left(self.starts, b)

    def around(self, i: int, j: int, left: str | None = None, right: str | None = None) -> list[int]:
        """Contexts of words i to j: the word before and the one before that, the word after and the one after that, each with
        what separates it; beyond the end of a sentence all are one. ``left`` and ``right`` are the gaps if no words fill the place."""
        a = self._context(i - 1, self.gaps[i] if left is None else left) if i > 0 else _BEYOND
        b = self._context(i - 2, self.gaps[i - 1]) if i > 1 and a != _BEYOND else _BEYOND
        n = len(self.codes)
        c = self._context(j + 1, self.gaps[j + 1] if right is None else right) if j + 1 < n else _BEYOND
        d = self._context(j + 2, self.gaps[j + 2]) if j + 2 < n and c != _BEYOND else _BEYOND
        return [a, b, c, d]

    def _context(self, i: int, gap: str) -> int:
        cls = self.codes[i] & 63
        if gap == " ":
            return cls
        sep = _separator(gap)
        if sep == 3:
            return cls if cls == _TITLE and gap in (". ", ".") else _BEYOND
        return sep * _K + cls


def _names(w: Words) -> list[tuple[int, int, int, int]]:
    """(first word, last word, first and last word of its run) of every part of two to five words of every run of name-shaped words,
    and of single ones after a title."""
    text, codes, gaps, starts, ends = w.text, w.codes, w.gaps, w.starts, w.ends
    size = len(text)
    runs: list[tuple[int, int]] = []
    first = last = -9
    semi = False
    for i in [i for i, c in enumerate(codes) if c & (NAMEY | SEMI)]:
        c, a, b = codes[i], starts[i], ends[i]
        if b < size and text[b] in "_@0123456789" or a and text[a - 1] in "_@-/0123456789":
            continue
        if b - a == 1 and (c >> _SHAPE) & 7 == INITIAL and text[b : b + 1] != "." and (not text[a].isupper() or text[a] in "AI"):
            continue
        if last == i - 1 and first >= 0:
            gap = gaps[i]
            if gap == " " or gap == "\xa0" or gap in (". ", ".") and ends[last] - starts[last] == 1:
                last = i
                semi |= bool(c & SEMI)
                continue
        if first >= 0:
            runs += _settle(codes, first, last) if semi else [(first, last)]
        first = last = i
        semi = bool(c & SEMI)
    if first >= 0:
        runs += _settle(codes, first, last) if semi else [(first, last)]
    out = []
    for s, e in runs:
        if s and codes[s - 1] & 63 == _TITLE and gaps[s] in (" ", ". ", ".", "\xa0"):
            out.append((s, s, s, e))
        elif s == e:
            continue
        for i in range(s, e):
            out += [(i, j, s, e) for j in range(i + 1, min(e, i + 4) + 1)]
    return out


def _settle(codes: list[int], first: int, last: int) -> list[tuple[int, int]]:
    """Parts of a run with common words in capitals: all of it if it stands alone among other words, else its other words only."""
    upper = lambda i: 0 <= i < len(codes) and (codes[i] >> _SHAPE) & 7 == UPPER
    if last - first < 5 and not upper(first - 1) and not upper(last + 1):
        return [(first, last)]
    parts, start = [], None
    for i in range(first, last + 2):
        plain = i <= last and not codes[i] & SEMI
        if plain and start is None:
            start = i
        elif not plain and start is not None:
            parts.append((start, i - 1))
            start = None
    return parts


def _numbers(text: str) -> set[tuple[int, int, int]]:
    """Sequences of digit groups of 7 to 16 digits with and without their first or last groups, and codes of letters and digits."""
    out: set[tuple[int, int, int]] = set()
    for m in _DIGITS.finditer(text):
        every = len(m[0].translate(_NO_DIGITS))
        if every < 7:
            continue
        a, b = m.span()
        while a and text[a - 1] in "(+":
            a -= 1
        while not text[b - 1].isdigit():
            b -= 1
        if not _CALENDAR.match(text, a, b):
            groups = [g.span() for g in _GROUP.finditer(text, a, b)]
            last = len(groups) - 1
            deep = 1 if every <= 15 else last
            parts = {(0, last), *((i, last) for i in range(1, min(last, deep) + 1)), *((0, j) for j in range(max(0, last - deep), last))}
            for i, j in parts:
                n = sum(y - x for x, y in groups[i : j + 1])
                x, y = groups[i][0], groups[j][1]
                if 7 <= n <= 16 and not text[y : y + 1].isalnum():
                    start = x
                    low = groups[i - 1][1] if i else a
                    while start > low and text[start - 1] in "(+":
                        start -= 1
                    before = text[start - 1] if start else " "
                    if before.isalnum() or before in "_@/":
                        continue
                    if n <= 15 and text.count("(", start, y) == text.count(")", start, y):
                        out.add((start, y, PHONE))
                    if n >= 8:
                        out.add((x, y, ID_NUMBER))
    for m in _CODE_AT.finditer(text):
        a = m.start()
        if a and not text[a - 1].isalpha() and not (a > 1 and text[a - 1] in "- \t\n\xa0" and text[a - 2].isalpha()):
            continue
        for x in _ID.finditer(text, max(0, m.start() - 6), min(len(text), m.end() + 18)):
            out.add((x.start(), x.end(), ID_NUMBER))
    return out


def propose(text: str, words: Words) -> list[tuple[int, int, int]]:
    """Distinct candidate spans (start, end, kind) of one text but its names, which ``_names`` gives."""
    low = _level(text)
    out = _numbers(text)
    spoken = 0

    def address(m) -> None:
        city = m.group("city")
        if city and not m.group("pin"):
            out.add((m.start(), m.start("city") - 2, ADDRESS_KIND))
            if city.lower() in _CLASS_OF:
                return
        out.add((m.start(), m.end(), ADDRESS_KIND))

    for end, (side, n) in _anchors().iter(" " + low):
        if side == "M":
            m = _AT.match(low, end - n + (n == 4 and low[end - n : end - n + 1] == " "))
            if m:
                stop = m.start()
                if stop and text[stop - 1].isspace():
                    stop -= 1
                start = stop
                while start and text[start - 1] in _USER:
                    start -= 1
                while start < stop and not text[start].isalnum():
                    start += 1
                b = start < stop and _DOMAIN.match(text, m.end())
                if b:
                    out.add((start, b.end(), EMAIL))
        elif side == "A":
            m = _UNIT_AT.match(text, end - n)
            x = m and ADDRESS.match(text, m.start())
            if x:
                address(x)
        elif end - n >= spoken:
            m = _SPOKEN.match(low, end - n)
            if m:
                spoken = m.end()
                out.add((m.start(), m.end(), PHONE))
    for i in [i for i, c in enumerate(words.codes) if c & 63 == _PLACE]:
        m = _LEADING_NUMBER.search(text, max(0, words.starts[max(0, i - 2)] - 8), words.starts[i])
        x = m and NUMBERED.match(text, m.start())
        if x:
            address(x)
    return sorted(out)


#: Names of the columns of ``measure``; after them come the weights of the four context words.
COLUMNS = [  # of names, digits is letters a piece of the vocabulary, letters the mixture of cases
    "kind", "words", "title_case", "upper", "lower", "initials", "devanagari", "common", "ending", "role", "titled", "more_left", "more_right", "length", "shortest", "longest",
    "digits", "letters", "groups", "first_group", "last_group", "longest_group", "plus", "zero", "dots", "commas", "hyphens", "blanks", "phone_cue", "id_cue", "account_cue", "money_cue", "mail_cue",
    "glued", "spelled_at", "tail_word", "unit_first", "next_capital",
]


def measure(text: str, words: Words, lex: Lexicon) -> tuple[list[tuple[int, int, int]], list[list[float]], list[list[int]]]:
    """Candidate spans of one text with the numbers of their format and the ids of their context: two words on either side."""
    spans: list[tuple[int, int, int]] = []
    rows: list[list[float]] = []
    contexts: list[list[int]] = []
    codes, starts, ends, gaps, size = words.codes, words.starts, words.ends, words.gaps, len(text)
    for i, j, s, e in _names(words):
        a, b = starts[i], ends[j]
        shapes = [0] * 6
        common = ending = role = pieces = 0
        shortest = longest = ends[i] - a
        for k in range(i, j + 1):
            c = codes[k]
            shapes[(c >> _SHAPE) & 7] += 1
            common += (c & COMMON) > 0
            ending += (c & ENDING) > 0
            role += c & 63 == _ROLE
            pieces += c >> _PIECES
            n = ends[k] - starts[k]
            if n > 1:
                shortest, longest = min(shortest, n), max(longest, n)
        spans.append((a, b, NAME))
        rows.append([
            NAME, j - i + 1, shapes[TITLE] + shapes[MIXED], shapes[UPPER], shapes[LOWER], shapes[INITIAL], shapes[DEVANAGARI], common, ending, role, i > 0 and codes[i - 1] & 63 == _TITLE,
            i - s, e - j, b - a, shortest, longest, (b - a) / max(pieces, 1), shapes[LOWER] * (shapes[TITLE] + shapes[UPPER]), 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
            j + 1 < len(codes) and (codes[j + 1] >> _SHAPE) & 7 in (TITLE, UPPER) and gaps[j + 1] == " ",
        ])
        contexts.append(words.around(i, j))
    for a, b, kind in propose(text, words):
        s = text[a:b]
        i, j = words.near(a, b)
        gap = text[ends[i] : a] if i >= 0 else text[:a]
        cues = [0] * len(_CUES)
        between = gap
        for k in range(i, max(-1, i - 5), -1):
            if between != " " and _separator(between) == 3:
                break
            q = _CUE_AT.get(codes[k] & 63)
            if q is not None:
                cues[q] = 1
            between = gaps[k]
        if kind == EMAIL:
            cues[4] = 1
        groups = [len(g) for g in _GROUP.findall(s)] or [0]
        digits = sum(groups)
        tail = s.rsplit(", ", 1)[-1] if kind == ADDRESS_KIND else ""
        low_tail, plain_tail = tail[:1].islower(), tail != "" and lex[tail.split()[0]] & COMMON > 0 if tail[:1].isalpha() else False
        spans.append((a, b, kind))
        rows.append([
            kind, s.count(" ") + 1, low_tail, s.islower(), s.isupper(), plain_tail, 0, 0, 0, 0, 0, 0, 0, b - a, 0, 0,
            digits, len(_LETTER.findall(s)) if digits < b - a else 0, len(groups), groups[0], groups[-1], max(groups), s[0] in "+(", s[0] == "0", s.count("."), s.count(","), s.count("-") + s.count("/"), s.count(" "), *cues,
            a > 0 and (text[a - 1].isalnum() or text[a - 1] in "-/._@:") or b < size and (text[b].isalnum() or text[b] in "/_@:" or text[b] in ".-," and text[b + 1 : b + 2].isdigit()),
            kind == EMAIL and "@" not in s, tail != "" and any(_CLASS_OF.get(x.lower(), _PLACE) != _PLACE for x in tail.split()), not s[0].isdigit(),
            text[b : b + 2] == ", " and text[b + 2 : b + 3].isupper(),
        ])
        contexts.append(words.around(i + 1, j - 1, gap, text[b : starts[j]] if j < len(starts) else ""))
    return spans, rows, contexts


#: Fixed values for composed sentences: syllables of made names, common given and family names, plain words.
_SYLLABLES = ["ba", "ro", "ti", "mel", "kon", "dra", "shi", "vel", "tam", "pu", "nes", "gor", "la", "wi", "jen", "hok", "sur", "fi", "an", "or", "bhe", "ush", "zal", "ik", "mon", "rak", "del", "ya"]
_GIVEN = [
    "Ravi", "Anita", "Sunil", "Priya", "Rahul", "Meera", "Arjun", "Kavita", "Suresh", "Lakshmi", "Imran", "Fatima", "Joseph", "Maria", "John", "Mary", "David", "Sarah",
    "Michael", "Emma", "Carlos", "Elena", "Wei", "Yuki", "Ahmed", "Olga", "Peter", "Nina", "Thomas", "Julia", "Gopal", "Sita", "Harpreet", "Zara",
]
_FAMILY = [
    "Kumar", "Sharma", "Singh", "Patel", "Reddy", "Iyer", "Khan", "Das", "Gupta", "Nair", "Smith", "Johnson", "Brown", "Garcia", "Miller", "Wilson", "Fernandes", "Pereira",
    "Ali", "Chen", "Tanaka", "Ivanova", "Schmidt", "Rossi", "O'Brien", "Cohen", "Novak", "Silva", "Hughes", "Clarke", "Banerjee", "Joshi", "Engineer", "Baker",
]
_ADJECTIVES = [
    "rusty", "crooked", "hollow", "dusty", "gilded", "creaking", "sodden", "tattered", "polished", "lacquered", "crimson", "weekly", "broken", "spare", "unsigned", "yellow", "grimy", "wobbly", "speckled", "dented",
    "frosted", "leaky", "mouldy", "ornate", "padded", "scuffed", "slanted", "stripy", "tarred", "threadbare", "wicker", "woollen", "zigzag", "copper", "cobalt", "beige", "maroon", "squeaky", "lopsided", "varnished",
]
_NOUNS = [
    "wheelbarrow", "lantern", "ledger", "kettle", "trellis", "gearbox", "turnip", "bannister", "hosepipe", "wardrobe", "sprocket", "teapot", "mattress", "logbook", "padlock", "crate", "register", "photograph", "handset", "parcel",
    "invoice", "receipt", "windowpane", "ration", "canister", "sack", "gate", "dispatch", "tarpaulin", "scaffold", "millstone", "tollbooth", "weathervane", "drawbridge", "haystack", "cartwheel", "chandelier", "gramophone", "typewriter", "cauldron",
    "hammock", "thimble", "spindle", "crowbar", "bobbin", "tugboat", "flagpole", "doorbell", "quarry", "orchard", "sawmill", "henhouse", "drainpipe", "bookshelf", "signpost", "armchair",
]
_COMMON_PLACES = ["Lake", "Hill", "Rose", "Church", "Mill", "River", "Temple", "School", "Sunrise", "Garden", "Palm", "Queen", "Victoria", "Green", "Bank"]
_HALVES = ["river", "dock", "lamp", "wood", "stone", "water", "fire", "rail", "sea", "hand", "side", "box", "house", "yard", "mill", "light", "bell", "gate", "wheel", "salt", "corn", "wind", "wall", "field", "ship", "glass", "iron", "sand", "moon", "farm"]
_VERBS = ["absconded", "trespassed", "relented", "testified", "retorted", "sauntered", "overslept", "eloped", "haggled", "fidgeted", "conceded", "demurred", "protested", "recanted", "resigned", "vouched", "stammered", "hesitated", "surrendered", "countersigned"]
_HEADINGS = [
    "report", "statement", "summary", "notice", "review", "transaction", "incident", "payment", "weekly", "daily", "general", "final", "first", "information", "request", "order", "complaint", "delivery", "transfer", "inventory",
    "purchase", "annual", "board", "meeting", "minutes", "terms", "account", "site", "inspection", "record", "internal", "memo", "call", "detail", "charge", "sheet", "case", "diary", "property", "search", "hearing", "crime", "branch", "cyber", "cell", "witness", "entry", "copy",
]
_HINDI_NOUNS = ["गाड़ी", "कागज़", "दरवाज़ा", "किताब", "पैसा", "चाबी", "बैंक", "रास्ता", "खिड़की", "थैला", "लाल", "पुरानी", "बंद", "नया", "भारी", "मकान", "दुकान", "पुलिस"]

#: Sentence frames. N a name, perhaps with title; n without; P, M, I, A phone, mail, identity number, address; H a Hindi name;
#: D date, O firm, L place of several words, W of one, V vehicle, S sum, X hash, C code of a cell, T heading, Q adjective and
#: noun, J Hindi words, R role, digits so many digits. From each group of four the last is held out.
FRAMES = [
    "Please forward the parcel to {N} before {D}.", "{N} joined the {Q} team last spring and reports to {N}.", "We thank {N} for the quick reply.", "Yesterday {N} rang the front desk twice.",
    "My landlord {N} wants the rent paid on {D}.", "The invoice was approved by {N} and countersigned by {N}.", "Dear {N}, your visit is on {D}.", "{N} (aged 42) was taken to {W} hospital.",
    "Ring {N} on {P} after six.", "The prize went to {N}, who lives at {A}.", "When {N} arrived, the {Q} had been sold.", "I saw {N} near the {Q} and spoke with {N} for an hour.",
    "{n}, {n} and {n} attended the meeting in {L}.", "Neither {N} nor {N} could open the {Q}.", "According to {N}, the {Q} is missing.", "Contact: {n}, {P}, {M}",
    "Name: {n}\nPhone: {P}\nAddress: {A}", "Passport number {I} was issued to {N} in {W}.", "The licence {I} expired on {D}.", "Send a copy to {M} and call {P}.",
    "The caller used {P} and asked for {N}.", "{N} was arrested at {L} with a {Q}.", "{N} has moved from {W} to {W}.", "{O} hired {N} as {R} on {D}.",
    "The {R} {n} opened the {Q}.", "{N}'s car, {V}, was found near {L}.", "The {Q} of {O} was closed, and {O} denied the charge.", "Account {7} of {O} received {S} on {D}.",
    "The vehicle {V} passed the {Q} at {L}.", "Serial {X} is stamped on the {Q}.", "Order {5} was shipped from {L} on {D}.", "{T}",
    "The {Q} and the {Q} were counted by the {R}.", "PERSON_B gave the {Q} to ORG_C.", "Chapter 3: {T}", "The {R} said that the {Q} was stolen from {L}.",
    "Deliver to {A} by {D}.", "We moved from {A} to {A} last year.", "Our shop is at {A}, next to {L}.", "The meeting was held at {A}.",
    "Write to {A}. We reply within a week.", "National insurance no. {I}, tax card {I}.", "My number is {P}; my sister has {P}.", "Ring me at {P} or {P}.",
    "Email {M} or {M} for details.", "Mast {C} logged the handset at noon.", "Reference {C}, batch {5}, page 12.", "On {D} {N} lent {N} {S} for a {Q}.",
    "Ask {N} whether {N} paid.", "{N} knows {N} from school.", "The letter from {N} to {N} was never opened.", "They introduced {N} to the {R}.",
    "A cheque signed by {N} for {O} bounced.", "It was {N} who broke the {Q}.", "Nothing is known about {N}.", "If {N} calls, tell them that {N} left.",
    "{N}, living at {A}, runs a {Q} shop.", "{N}: I never saw the {Q}.", "From: {n} <{M}>", "The tenant, {N}, of {A}, owes {S}.",
    "{N}, residing in {A}, fell ill.", "{N} refused to pay {N}.", "{N} handed the {Q} to {N}.", "{N} used to live near {L}.",
    "{N}, r/o {A}, has paid.", "The {R}, resident of {A}, came late.", "{n}, residing at {A}, was seen.", "A man living at {A}, is ill.",
    "Goods for {A} will come on {D}.", "{N}, of {A}, took the {Q}.", "From {A} she went home.", "At {A}, where {N} lives, a {Q} lay.",
    "The {R} told the {R} that {N} had left.", "{N} had a {Q}. {N} wanted it.", "Note 7-C: {N}, aged 50, slept.", "Nobody knew when {N} had come.",
    "They could not reach {N} by phone.", "{N} is a {R} with {O}.", "The {R} of {O} met the {R} of {O}.", "{N} did not return the {Q} to {O}.",
    "Account number {11} at {O} is frozen.", "Tracking no. {12} was lost in {W}.", "Hash {X} was computed on {D}.", "Case {3}/2021 and entry {3}-B were merged.",
    "{N} added that {N} was absent.", "Later {N} swore that {N} had fled.", "Did {N} ever visit {N}?", "Anyone who met {N} may write to {M}.",
    "Mail came from {M} about {O}.", "Parcel {8} weighs 12.5 kg.", "The {R} paid {S} to {O} in {W} {D}.", "Meeting with {N}, {T}, {D}",
    "{N}, aged 34, of {W}, lost the {Q}.", "We spoke to {N} on {D} in {L}.", "\"{N} is late,\" said {N}.", "There is no doubt that {N} saw the {Q}.",
    "Card {I} was shown by {N} at the gate.", "Without {N} the {Q} would have burned.", "Only {N} has the key, said the {R}.", "The photo shows {N} with {N} in front of {L}.",
    "The {Q} was moved to {L} because the {Q} leaked.", "In {L} every {Q} is taxed by the {R}.", "He went by {L} and {L} on {D}.", "As per {O}, the {Q} arrived on {D}.",
    "{S} was found in a {Q}, and {S} in another.", "The {Q}, rather than the {Q}, fell under the {Q}.", "Version 10.2.33 of {D} fixes the {Q}.", "Sixty-two {Q}s were relabelled despite the {Q}.",
    "{N} works near {L}.", "The flat of {N} is {A}.", "{N} and {O} share {A}.", "The keys of {A} are with {N}.",
    "{N} ko bolo ki {P} pe call kare.", "Aaj {N} aaya tha {W} se.", "Mere bhai {N} ka samaan rakho.", "{N} aur {N} saath gaye.",
    "Yeh {N} ka ghar hai, {A}.", "Uski email {M} hai.", "Bhai {P} pe message karo.", "Subah {N} ne paisa diya.",
    "Mujhe {N} ne kaha ki {W} chalo.", "Main {N} hoon aur {A} mein kaam karta hoon.", "Gaadi {V} {L} ke paas thi.", "Khata {7} mein {S} daalo.",
    "{N} ne {I} wala card dikhaya.", "Hamara office {A} par hai.", "Kal raat {N} ne phone kiya.", "{N} hi woh aadmi hai jo {W} gaya.",
    "{H} ने दुकान खोली।", "कल {H} बाज़ार आया था।", "{H} को पत्र मिला।", "श्री {H} और {H} मिले।",
    "मेरा नाम {H} है।", "{H} का घर {W} में है।", "मित्र {H} ने कहा कि {J} खो गया।", "अधिकारी {H} ने {D} को रिपोर्ट दी।",
    "{J} {J} के पास खड़ी थी।", "{J} की {J} लगी है।", "राशि {S} की {J} में जमा हुई।", "{H} व {H} साथ गए और {J} लाए।",
    "फोन {P} पर बात करें, ईमेल {M} है।", "कार्ड {I} जमा किया गया।", "{D} को {H} ने {J} बेची।", "संख्या {I} वाला पहचान पत्र {H} का है।",
    "{w} {P} {w}", "{w}: {I}", "{w} {M} {w}", "{w}, {A}, {w}",
    "{N} {Y} that {N} {Y} at dawn.", "{N} {Y}.", "Then {N} {Y} in {L}.", "{N} {Y} and the {R} {Y} too.",
    "A text came from {P} at noon.", "His line {P} is dead.", "The lines {P} and {P} were busy.", "Nobody answers at {P} or {M}.",
    "{N} used {P} until {D}.", "Two messages went from {P} to {P} overnight.", "Her number {P} was blocked by {O}.", "Leave word at {P} before {D}.",
    "The handset with {P} was sold.", "Sixteen texts between {P} and {P} were read.", "It came through {P}, then through {P}.", "Dial {P} and ask for {N}.",
    "The original of {I} was lost.", "A scan of {I} came by post.", "{N} carries {I}.", "Proof {I} was accepted by {O}.",
    "The form lists {I} and {I}.", "Against {I} the {R} wrote a note.", "Voter slip {I} is torn.", "The number on the card, {I}, was false.",
    "Although {Q}s fell, {Q}s rose.", "Forty {Q}s and {Q}s lay under {Q}s.", "Although fifty-one {Q}s say so, {O} paid.", "He mixed {Q} with {Q} near old {Q}s.",
    "Was the {Q} a {Q}? Every {Q}, said the {R}, is {Q}.", "Between {Q}s, nobody counts {Q}s.", "Boxes of {Q}s were described as {Q}s.", "The {Q} {Q} of {Q}s was insured.",
    "{J} {J} {J} नहीं मिली।", "{J} और {J} {J} में थे।", "पुराने {J} में {J} और {J} थे।", "कोई {J} {J} के पास नहीं थी।",
    "{T} - {O}", "{T}\n\n{N} {Y}.", "{T} of {D}\nNo. {3}/2021", "The {T} of {O} and {N}",
    "{T} - {T}", "STATEMENT OF {R}\nRecorded on {D}", "{T}: {w} {w}", "{T}, page 3",
    "Bill {9} and coupon {8} are void.", "{D} to {D}: closed.", "Since {D} {D} nothing came from {O}.", "Lot {4}.{3}.{2} of {D} holds {Q}s.",
]


#: Classes of the arbitrary words.
_LOOSE_HINDI = ["postposition", "hindi_joint", "hindi_verb", "hindi_other", "role", "time"]
_LOOSE = ["agent_preposition", "place_preposition", "preposition", "conjunction", "auxiliary", "pronoun", "negation", "verb", "time", "kin", "residence"]


def labelled_rows(n: int = 8000, seed: int = 11, frames: list[str] = FRAMES) -> list[tuple[str, set[tuple[str, str]], int]]:
    """``n`` composed sentences with their personal items as (kind, text) and the number of their frame; the bound on the training rows."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choices("0123456789", k=k))
    letter = lambda k: "".join(r.choices("ABCDEFGHJKLMNPQRSTUVWXYZ", k=k))

    def word() -> str:
        return "".join(r.choices(_SYLLABLES, k=r.randint(2, 4))).capitalize()

    def styled(text: str) -> str:
        return r.choice([text] * 6 + [text.lower(), text.upper()])

    def bare() -> str:
        given, family = (r.choice(_GIVEN), r.choice(_FAMILY)) if r.random() < 0.35 else (word(), word())
        form = r.random()
        if form < 0.6:
            return styled(f"{given} {family}")
        if form < 0.75:
            return styled(f"{given} {word()} {family}")
        if form < 0.9:
            return styled(f"{letter(1)}. {family}")
        return styled(f"{given} {letter(1)}. {family}")

    def name() -> tuple[str, str]:
        if r.random() < 0.6:
            core = bare()
            return core, core
        title = r.choice(["Mr", "Mrs", "Ms", "Dr", "Prof", "Adv", "Shri", "Smt", "Kum"]) + r.choice(["", "."])
        core = bare() if r.random() < 0.6 else styled(r.choice([word(), r.choice(_FAMILY)]))
        return f"{title} {core}", core

    def phone() -> str:
        d = digit
        return r.choice([
            f"+91{d(10)}", f"+91 {d(5)} {d(5)}", d(10), "0" + d(10), f"{d(4)}.{d(3)}.{d(3)}", f"+91-{d(3)}-{d(3)}-{d(4)}", f"0091{d(10)}", f"{d(5)}-{d(5)}", f"(+91) {d(4)} {d(3)} {d(3)}", f"{d(3)} {d(3)} {d(4)}", f"{d(5)} {d(5)}",
            f"{d(4)} {d(3)} {d(3)}", f"+44 20 {d(4)} {d(4)}", f"555-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+49 {d(3)} {d(7)}", f"+91 {d(4)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(4)}", " ".join(r.choices(DIGIT_WORDS, k=10)),
        ])

    def ident() -> str:
        d = digit
        return r.choice([
            d(12), f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}", f"{letter(5)}{d(4)}{letter(1)}", f"{letter(5).lower()} {d(4)} {letter(1).lower()}", f"{letter(3)}{d(7)}", f"{letter(1)}{d(7)}", f"{letter(2)}-{d(2)} {d(11)}",
            f"{letter(2)}{d(13)}", f"{letter(2)} {d(2)} {d(2)} {d(2)} {letter(1)}", f"{letter(2)}{d(2)} {d(11)}", f"{letter(1)}{d(7)}".lower(),
        ])

    def mail() -> str:
        user = r.choice([word() + digit(2), f"{word()}.{word()}", f"{word()}_{letter(1)}", f"{word()}+{digit(1)}", word()]).lower()
        host = r.choice(["mail.test", "web.example.com", "post.invalid", "desk.example.net"])
        made = r.choice([f"{user}@{host}"] * 4 + [f"{user} @ {host}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user}(at){host}", f"{user} at {host.replace('.', ' dot ')}"])
        return r.choice([made, made, made, made.upper()])

    def address() -> str:
        called = lambda: r.choice(_COMMON_PLACES) if r.random() < 0.25 else word()
        street = f"{called()} {r.choice(['Street', 'Road', 'Lane', 'Marg', 'Avenue', 'St', 'Rd', 'Ln', 'Mg.', 'Raod'])}"
        number = r.choice([str(r.randint(1, 99)), f"{r.randint(1, 99)}-{letter(1)}", f"{r.randint(1, 99)}/{r.choice([digit(1), letter(1)])}", str(r.randint(1, 999))])
        local = [f"{called()} {r.choice(['Nagar', 'Colony', 'Market', 'Layout', 'Enclave', 'Vihar'])}"] * (r.random() < 0.7)
        city = [r.choice([word(), f"{word()} {digit(6)}", f"{word()} {digit(6)}"])] * (r.random() < 0.7)
        if r.random() < 0.3:
            return ", ".join([f"{number} {street}", *local, *city])
        unit = r.choice(["House No", "House", "H.No.", "Flat", "Flat No.", "Fl. No.", "Shop", "Shop No.", "Sh. No.", "Plot", "Plt", "P.No.", "Godown", "Gdn", "Godown No.", "D.No.", "#"])
        building = [f"{called()} {r.choice(['Apartments', 'Complex', 'Towers', 'Bhavan', 'Chambers'])}"] * (r.random() < 0.4)
        return ", ".join([f"{unit} {number}", *building, street, *local, *city])

    def hindi(k: int) -> str:
        part = lambda: r.choice("कखगघचजटडतदनपबभमरलवशसह") + r.choice(["", "ा", "ि", "ी", "ु", "े", "ो"])
        return "".join(part() for _ in range(k))

    def firm() -> str:
        base = r.choice([word(), word(), f"{word()} {word()}"])
        return f"{base} {r.choice(['Exports', 'Foods', 'Media', 'Steel Works', 'Traders', 'Motors', 'Bank', 'Chemicals'])} {r.choice(['Ltd', 'Pvt Ltd', 'and Sons', 'LLP', ''])}".strip()

    half = lambda: r.choice(_HALVES)
    place = lambda: r.choice([f"{word()} {r.choice(['Nagar', 'East', 'Market', 'Station', 'Road', 'Chowk', 'Park'])}", f"{word()} police station", f"North {word()}"])
    date = lambda: r.choice([f"{digit(2)}/{digit(2)}/2025", f"{digit(1)} Jan 2026", "2025-01-02", f"{r.randint(10, 28)}-0{r.randint(1, 9)}-2024", f"{r.randint(1, 9)}.5.25", f"2024-0{r.randint(1, 9)}-{r.randint(10, 28)} 10:15", "14.11.2025", f"March {r.randint(1, 28)}, 2024"])
    plain = {
        "D": date, "O": firm, "W": word, "L": place, "X": lambda: "".join(r.choices("0123456789abcdef", k=32)), "C": lambda: f"{letter(3)}-{digit(1)}-{digit(5)}", "T": lambda: styled(" ".join(r.sample(_HEADINGS, r.randint(2, 4))).title()),
        "V": lambda: f"{letter(2)} {digit(2)}{r.choice([' ', '-'])}{letter(2)}{r.choice([' ', '-'])}{digit(4)}", "S": lambda: r.choice([f"Rs. {digit(2)},{digit(3)}", f"INR {digit(5)}", "two lakh fifty thousand rupees", f"{digit(1)}.5 lakh", f"Rs {digit(6)}"]),
        "Q": lambda: f"{r.choice([*_ADJECTIVES, half() + half()])} {r.choice([*_NOUNS, half() + half(), half() + half()])}", "Y": lambda: r.choice(_VERBS), "J": lambda: r.choice(_HINDI_NOUNS), "R": lambda: r.choice(["clerk", "driver", "manager", "cashier", "guard", "witness", "complainant", "desk officer", "inspector"]), "w": lambda: r.choice([word().lower(), r.choice(_NOUNS)]),
    }
    made = {"P": ("PHONE", phone), "M": ("EMAIL", mail), "I": ("ID_NUMBER", ident), "A": ("ADDRESS", address), "n": ("NAME", bare), "H": ("NAME", lambda: f"{hindi(r.randint(2, 3))} {hindi(r.randint(2, 4))}")}
    rows = []
    for k in range(n):
        gold: set[tuple[str, str]] = set()

        def put(m, gold=gold):
            c = m[1]
            if c == "N":
                whole, core = name()
                gold.add(("NAME", core))
                return whole
            if c in made:
                value = made[c][1]()
                gold.add((made[c][0], value))
                return value
            return plain[c]() if c in plain else digit(int(c))

        form = frames[k % len(frames)]
        number = k % len(frames)
        if k % 3 == 0:  # every third row is a lone item among arbitrary words of the classes
            number = len(frames) + k // 3
            some = lambda: " ".join(r.choice(WORD_CLASSES[r.choice(_LOOSE)][:40]) if r.random() < 0.7 else r.choice([half() + half(), r.choice(_NOUNS), r.choice(_VERBS)]) for _ in range(r.randint(1, 3)))
            form = f"{some()} {{{r.choice('NNNNPPPIIIMAAOOLQQTVCSDDX')}}}{r.choice(['', '', '', '.', ','])} {some()}"
            form = form[0].upper() + form[1:] if r.random() < 0.5 else form
            if r.random() < 0.15:
                some = lambda: " ".join(r.choice([w for w in WORD_CLASSES[r.choice(_LOOSE_HINDI)] if not w.isascii()]) for _ in range(r.randint(0, 3)))
                form = f"{some()} {{{r.choice('HHHJJPIMDS')}}} {some()} {{{r.choice('HJJW')}}} {some()}।".strip()
        text = re.sub(r"\{(\w+)\}", put, form)
        text = r.choice(["", "", "", "The office is closed on Sundays. ", "It was so.  ", "Re: rent\n"]) + text + r.choice(["", "", " The matter goes on.", "  It ended.", " Nobody came"])
        style = r.random()
        if style < 0.1:
            text, gold = (text.lower(), {(a, b.lower()) for a, b in gold}) if style < 0.06 else (text.upper(), {(a, b.upper()) for a, b in gold})
        rows.append((text, gold, number))
    return rows


def _weights(contexts: np.ndarray, kinds: np.ndarray, y: np.ndarray, strength: float = 4.0) -> np.ndarray:
    """(kind, place, context) log-odds of a personal item beyond those of its kind, smoothed towards the word class and zero."""
    out = np.zeros((len(KINDS), 4, 8 * _K))
    for kind in range(len(KINDS)):
        mine = kinds == kind
        if not mine.any():
            continue
        prior = float(np.clip(y[mine].mean(), 0.01, 0.99))
        base = np.log(prior / (1 - prior))
        for slot in range(4):
            c = contexts[mine, slot]
            pos, every = np.bincount(c, y[mine], 8 * _K), np.bincount(c, minlength=8 * _K)
            by_class = np.bincount(c % _K, y[mine], _K), np.bincount(c % _K, minlength=_K)
            share = (by_class[0] + strength * prior) / (by_class[1] + strength)
            share = np.tile(share, 8)
            p = (pos + strength * share) / (every + strength)
            out[kind, slot] = np.log(p / (1 - p)) - base
    return out


class Detector:
    """Trees of each kind, context weights and thresholds; ``f1`` is measured on held-out frames."""

    def __init__(self, path: str, models: list[BoostedTrees], weights: np.ndarray, cuts: np.ndarray, f1: float):
        self.path, self.models, self.weights, self.cuts, self.f1 = path, models, weights, cuts, f1

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Personal items of each text as (start, end, kind)."""
        lex = lexicon(self.path)
        found = [measure(t, Words(t, lex), lex) for t in texts]
        rows = [r for _, m, _ in found for r in m]
        if not rows:
            return [[] for _ in texts]
        x = _with_context(np.array(rows, dtype=np.float32), np.array([c for _, _, cs in found for c in cs]), self.weights)
        p = _judge(self.models, x)
        out, at = [], 0
        for spans, _, _ in found:
            out.append(select(spans, p[at : at + len(spans)], self.cuts))
            at += len(spans)
        return out


def _judge(models: list[BoostedTrees], x: np.ndarray) -> np.ndarray:
    p = np.zeros(len(x))
    for kind, model in enumerate(models):
        mine = np.flatnonzero(x[:, 0] == kind)
        if len(mine):
            p[mine] = model.probability(x[mine])
    return p


def _with_context(x: np.ndarray, contexts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    kinds = x[:, 0].astype(int)
    return np.concatenate([x, *[weights[kinds, s, contexts[:, s]][:, None] for s in range(4)]], axis=1, dtype=np.float32)


@functools.cache
def trained(rows: int = 8000, seed: int = 11, path: str | None = None) -> Detector:
    """The detector fitted on ``rows`` labelled sentences; every fourth frame is held out, whole, to calibrate and measure."""
    path = path or vocabulary.default_path()
    lex = lexicon(path)
    xs, cs, ys, frames = [], [], [], []
    for text, gold, frame in labelled_rows(rows, seed):
        spans, rows_, contexts = measure(text, Words(text, lex), lex)
        for (a, b, kind), m, c in zip(spans, rows_, contexts):
            xs.append(m)
            cs.append(c)
            ys.append((KINDS[kind], text[a:b]) in gold)
            frames.append(frame)
    x, c, y, frame = np.array(xs, dtype=np.float32), np.array(cs), np.array(ys, dtype=float), np.array(frames)
    kinds, hold = x[:, 0].astype(int), frame % 4 == 3
    weights = _weights(c[~hold], kinds[~hold], y[~hold])
    # the trees see each row's context weights as fitted on other frames
    full = _with_context(x, c, weights)
    for fold in range(3):
        mine, rest = frame % 4 == fold, (frame % 4 != fold) & ~hold
        full[mine] = _with_context(x[mine], c[mine], _weights(c[rest], kinds[rest], y[rest]))
    models = [BoostedTrees(rounds=80, depth=5).fit(full[~hold & (kinds == k)], y[~hold & (kinds == k)]) for k in range(len(KINDS))]
    p = _judge(models, full[hold])
    cuts = np.full(len(KINDS), 0.5)
    for kind in range(len(KINDS)):
        mine, best = kinds[hold] == kind, -1.0
        for t in np.linspace(0.1, 0.9, 33):
            hit = ((p >= t) & (y[hold] == 1) & mine).sum()
            # an item left in the text costs more than a word too much
            f2 = 5 * hit / max(1, ((p >= t) & mine).sum() + 4 * ((y[hold] == 1) & mine).sum())
            if f2 > best + 1e-9 or abs(f2 - best) <= 1e-9 and abs(t - 0.5) < abs(cuts[kind] - 0.5):
                best, cuts[kind] = f2, t
    taken = p >= cuts[kinds[hold]]
    f1 = 2 * (taken & (y[hold] == 1)).sum() / max(1, taken.sum() + (y[hold] == 1).sum())
    return Detector(path, models, weights, cuts, float(f1))


def select(spans: list[tuple[int, int, int]], p: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans above their kind's threshold that don't overlap: the likeliest first, of equal ones the longest."""
    order = sorted((-round(float(q), 2), a - b, a, b, k) for (a, b, k), q in zip(spans, p.tolist()) if q >= cuts[k])
    starts: list[int] = []
    taken: list[tuple[int, int, int]] = []
    for _, _, a, b, k in order:
        i = bisect.bisect_left(starts, a)
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            starts.insert(i, a)
            taken.insert(i, (a, b, k))
    return taken


def _run(df: DataFrame, keys: list[str], text: str, rows: int, each, schema: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(trained(rows))
    inner = [f"_k{i}" for i in range(len(keys))]

    def run(frames):
        import pandas as pd

        for f in frames:
            values, texts = list(zip(*(f[c].tolist() for c in inner))), f["_t"].tolist()
            out = []
            for k in range(0, len(texts), 2048):
                found = shared.value.find([t or "" for t in texts[k : k + 2048]])
                for i, s in enumerate(found):
                    out += each(values[k + i], texts[k + i], s)
            yield pd.DataFrame(out, columns=[*inner, *(c.split()[0] for c in schema.split(", "))], dtype=object)

    typed = "".join(f"{c} {df.schema[key].dataType.simpleString()}, " for c, key in zip(inner, keys))
    made = df.select(*[F.col(key).alias(c) for c, key in zip(inner, keys)], F.col(text).alias("_t")).mapInPandas(run, typed + schema)
    return made.withColumnsRenamed(dict(zip(inner, keys)))


def find_personal(df: DataFrame, key: str, text: str, rows: int = 8000) -> DataFrame:
    """(``key``, pii_kind, found_text), one row for each distinct item of a text; whole texts of any length are searched.

    Null and empty texts have no item. Repeated rows give repeated items, a null key stays null, other columns are dropped.
    """
    each = lambda k, t, s: sorted({(*k, KINDS[c], t[a:b]) for a, b, c in s}, key=str)
    return _run(df.filter(F.col(text) != ""), [key], text, rows, each, "pii_kind string, found_text string")


def redact(df: DataFrame, key: str | list[str], text: str, rows: int = 8000) -> DataFrame:
    """(``key``, redacted): every row's text with its personal items replaced by [NAME], [PHONE] and so on; null stays null.

    ``key`` is one column or several, which are returned as they are.
    """

    def each(k, t, s):
        if t is None:
            return [(*k, None)]
        parts, at = [], 0
        for a, b, c in s:
            parts += [t[at:a], f"[{KINDS[c]}]"]
            at = b
        return [(*k, "".join([*parts, t[at:]]))]

    return _run(df, [key] if isinstance(key, str) else key, text, rows, each, "redacted string")
