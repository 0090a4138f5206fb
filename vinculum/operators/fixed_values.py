"""Word lists and patterns that results have to agree with. Nothing else stands here."""

from vinculum.schemas import B, E, L, O, P, PH, V

#: State codes of vehicle plates.
STATE_CODES = ["AP", "AR", "AS", "BR", "CG", "CH", "DD", "DL", "DN", "GA", "GJ", "HP", "HR", "JH", "JK", "KA", "KL", "LA", "LD", "MH", "ML", "MN", "MP", "MZ", "NL", "OD", "OR", "PB", "PY", "RJ", "SK", "TN", "TR", "TS", "UK", "UP", "WB"]

#: Words that are cut from the ends of a name.
TRIM_WORDS = ["was", "is", "are", "were", "and", "or", "attended", "seen", "held", "near", "at", "in", "to", "from", "on", "the", "a", "an", "listed", "suspect", "suspects", "accused", "complainant", "officer", "witness", "victim", "उपस्थित", "थे", "था", "थी", "है", "हैं", "के", "को", "ने", "से", "पर"]

#: What looks like a person's name and is none.
NON_PERSONS = [
    "first information", "case report", "police station", "cyber cell", "incident report", "investigation summary", "call record", "case file", "meeting on", "registered employer",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "listed", "suspects listed", "suspect", "suspects", "accused", "complainant", "officer", "witness", "victim",
]

#: Words that only organisations bear.
CORPORATE = ["ltd", "pvt", "llc", "llp", "inc", "corp", "corporation", "logistics", "industries", "bank", "enterprises", "company", "technologies", "solutions", "college", "university", "school", "department"]

#: Places that are recognised by name; the default of a parameter.
GAZETTEER = ["Bhubaneswar", "Cuttack", "Mumbai", "Delhi", "Bangalore", "Bengaluru", "Kolkata", "Hyderabad", "Chennai", "Odisha", "Maharashtra", "Karnataka"]

#: Roles that are no persons.
ROLES = ["accused", "associate", "brother", "complainant", "constable", "doctor", "driver", "employee", "english lecturer", "lecturer", "manager", "officer", "professor", "teacher", "victim", "witness", "worker"]

#: Last words of places.
PLACE_ENDS = ["airport", "bridge", "chowk", "district", "highway", "market", "nagar", "police station", "ps", "railway station", "road", "state", "station", "street", "terminal", "town", "village"]

#: Words of organisations.
ORG_WORDS = [
    "academy", "agency", "bank", "board", "branch", "bureau", "cell", "center", "centre", "clinic", "college", "commission", "company", "corps", "corporation", "counsel", "court", "department", "division",
    "firm", "forensic", "foundation", "hospital", "institute", "laboratory", "lab", "limited", "llc", "ltd", "police", "pvt", "school", "science", "service", "society", "syndicate", "transport", "trust", "university",
]

#: Legal and procedural phrases.
BOILERPLATE = [
    "additional district", "advocate", "advocate of", "appellant", "bail", "bail application", "case", "case no", "case number", "charge sheet", "crpc", "evidence act", "high court", "identification",
    "investigating", "ipc", "judgement copy", "law", "legal provisions", "log line", "order sheet", "panchnama", "party", "prosecution", "respondent", "sessions court", "standing counsel", "statements",
    "statute", "superintendent", "witness statement",
]

#: Pronouns and function words.
FUNCTION_WORDS = [
    "who", "whom", "whose", "which", "what", "that", "this", "these", "those", "he", "she", "it", "they", "them", "him", "her", "his", "their", "theirs", "its", "by", "and", "or", "the", "a", "an", "from", "into", "onto", "upon", "about",
    "someone", "anyone", "everyone", "nobody", "no one", "somebody", "anybody",
]

#: Roles in court.
COURT_ROLES = [
    "petitioner", "petitioner's daughter", "petitioners daughter", "petitioner daughter", "intervener", "intervenor", "respondent", "applicant", "deceased", "accused", "learned senior counsel",
    "senior counsel", "public prosecutor", "learned counsel", "division bench", "court of magistrate", "special executive magistrate", "magistrate", "hon'ble supreme court", "supreme court", "high court",
]

#: Citations of cases; fragments of sentences (Java patterns).
CITATION = r"(?iU)\b(?:vs\.?|versus|v/s|state\s+of|union\s+of\s+india|in\s+re\b|judgment\s+in\b|case\s+of\b|air\s+\d{4}|scc\s+\d{4})\b"
FRAGMENT = r"(?iU)\b(?:was\s+\w+|acted\s+as|built\s+an?|it\s+must|more\s+suspicion|though\s+\w+|referred\s+to|seen\s+at)\b"

#: Role phrases beside persons.
ROLE_PHRASE = r"(?i)\b(?:an?|the)\s+((?:[a-z]+\s+){0,2}(?:lecturer|teacher|professor|driver|manager|doctor|employee|worker))\b"

#: Type, confidence and pattern of mentions, in order of application; the pattern None stands for the gazetteer.
PATTERNS = [
    ("PHONE", 0.95, r"(?i)\b(?:PHONE|Mobile|Contact|Tel)[\s:=-]+([+]?[0-9][0-9\s-]{8,15}[0-9])"),
    ("PHONE", 0.90, r"(?:^|(?<=[\s,;:(]))([+]91[- ]?[6-9]\d{4}[- ]?\d{5}|[6-9]\d{9})(?=$|[\s,;:.)])"),
    ("BANK_ACCOUNT", 0.95, r"(?i)\b(?:ACCOUNT|A/C|Acct|ACC)[\s:#No.-]+([0-9]{9,18})\b"),
    ("VEHICLE", 0.95, r"(?i)\b(?:VEHICLE|Reg No|Vehicle No)[\s:=-]+([A-Z]{2}[ -]?[0-9]{1,2}[ -]?[A-Z]{1,3}[ -]?[0-9]{4})\b"),
    ("VEHICLE", 0.90, r"\b([A-Z]{2}[ -]?[0-9]{1,2}[ -]?[A-Z]{1,3}[ -]?[0-9]{4})\b"),
    ("PERSON", 0.95, r"(?i)\b(?:PERSON|Suspect|Complainant|Accused|Officer|Witness|Victim)s?(?:\s+(?:listed|named|identified))?[\s:=-]+([A-Zऀ-ॿ][a-zऀ-ॿ.'-]*(?:\s+[A-Zऀ-ॿ][a-zऀ-ॿ.'-]*){0,3})"),
    ("PERSON", 0.90, r"\b(?:Mr\.|Mrs\.|Ms\.|Shri|Smt\.|Dr\.|Insp\.|Inspector|Sub-Inspector|SI|Constable)\s+([A-Zऀ-ॿ][a-zऀ-ॿ.'-]*(?:\s+[A-Zऀ-ॿ][a-zऀ-ॿ.'-]*){1,3})\b"),
    ("PERSON", 0.80, r"\b(?i:called|met|contacted)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"),
    ("PERSON", 0.80, r"\b([A-Z][a-z]+(?:\s+[A-Z](?:[a-z]+|\.?)){1,2})(?=$|[\s,;:.\n])"),
    ("ORGANIZATION", 0.95, r"(?i)\b(?:ORGANIZATION|Org|Company|Agency|Department)[\s:=-]+([A-Za-z0-9ऀ-ॿ][A-Za-z0-9ऀ-ॿ\s.&'-]{2,50})"),
    ("ORGANIZATION", 0.90, r"\b([A-Z][A-Za-z0-9&.'-]*(?:\s+(?:of|and|&|[A-Z][A-Za-z0-9&.'-]*))*\s+(?:Pvt\s+Ltd|Ltd|LLC|LLP|Inc|Corp|Corporation|Bank|Logistics|Industries|Enterprises|College|University|School|Department))\b"),
    ("ORGANIZATION", 0.85, r"\b([A-Z][A-Za-z\s]{2,30}\s+(?:Police Station|Cyber Cell|Department|Branch))\b"),
    ("LOCATION", 0.95, r"(?i)\b(?:LOCATION|Place|City|State|Address)[\s:=-]+([A-Za-zऀ-ॿ][A-Za-z0-9ऀ-ॿ\s,.-]{2,40})"),
    ("LOCATION", 0.85, None),
    ("LOCATION", 0.90, r"\b([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){0,3}\s+(?:Railway Station|Station|Airport|Market|Road|Street|Bridge|Terminal))\b"),
    ("EVENT", 0.90, r"(?i)\b(?:EVENT|Incident)[\s:=-]+([A-Za-z0-9ऀ-ॿ][A-Za-z0-9ऀ-ॿ\s,.-]{3,60})"),
    ("EVENT", 0.80, r"\b((?:Meeting|Transaction|Call|Seizure operation|Raid)\s+(?:on\s+\d{4}-\d{2}-\d{2}|at\s+[A-Za-z\s]+))\b"),
]

#: Relationship, trigger between source and target, and allowed types of the two, in order.
TRIGGERS = [
    ("CALLED", r"called|telephoned|phoned|dialed|placed a call to", [(P, P), (P, PH), (PH, PH)]),
    ("SENT_MONEY_TO", r"sent(?:\s+(?:money|funds|[₹$€]?\s*\d[\d,]*(?:\.\d+)?))?\s+to|transferred(?:\s+(?:money|funds|[₹$€]?\s*\d[\d,]*(?:\.\d+)?))?\s+to|paid(?:\s+[₹$€]?\s*\d[\d,]*(?:\.\d+)?)?\s+to|wired(?:\s+(?:money|funds|[₹$€]?\s*\d[\d,]*(?:\.\d+)?))?\s+to", [(P, P), (P, B), (B, B)]),
    ("OWNS_VEHICLE", r"owns(?:\s+the)?(?:\s+vehicle)?|owner of(?:\s+the)?(?:\s+vehicle)?|purchased(?:\s+the)?(?:\s+vehicle)?|registered owner of", [(P, V), (O, V)]),
    ("USED_VEHICLE", r"used(?:\s+the)?(?:\s+vehicle)?|drove(?:\s+the)?(?:\s+vehicle)?|fled in(?:\s+the)?(?:\s+vehicle)?|seen (?:driving|in)(?:\s+the)?(?:\s+vehicle)?|travelled in(?:\s+the)?(?:\s+vehicle)?", [(P, V)]),
    ("WORKS_FOR", r"works for|employed at|employed by|employee of|working (?:at|for)|works at|(?:an?|the)\s+(?:[a-z]+\s+){0,2}(?:lecturer|teacher|professor|manager|doctor|employee|worker)\s+at", [(P, O)]),
    ("LOCATED_AT", r"is located (?:at|in)|located (?:at|in)|seen (?:at|in)|spotted (?:at|in)|residing (?:at|in)|present (?:at|in)|arrested (?:at|in)|meeting at|met(?:\s+[A-Za-z.' -]+)?\s+at", [(P, L), (O, L), (V, L)]),
    ("ASSOCIATED_WITH", r"is associated with|associated with|linked to|affiliated with|partnered with", [(P, P), (P, O), (P, PH), (O, O)]),
    ("PART_OF_EVENT", r"participated in|attended|involved in|present (?:during|at)|part of", [(P, E), (O, E)]),
]

#: Words that negate a relationship.
NEGATION = r"(?i)\b(?:did not|didn't|does not|doesn't|never|not|was not|wasn't|failed to|denied)\b"
