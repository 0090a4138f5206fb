"""Enumerations, limits and the endpoint matrix of the linked-evidence model. All values here are fixed values."""

ENTITY_TYPES = ["PERSON", "ORGANIZATION", "PHONE", "BANK_ACCOUNT", "VEHICLE", "LOCATION", "EVENT"]
RELATIONSHIP_TYPES = ["CALLED", "SENT_MONEY_TO", "OWNS_VEHICLE", "USED_VEHICLE", "WORKS_FOR", "LOCATED_AT", "ASSOCIATED_WITH", "PART_OF_EVENT"]
STATUSES = ["PREDICTED", "INFERRED", "CONFIRMED"]  # by rising weight
PATTERN_TYPES = ["CIRCULAR_TRANSACTION", "RAPID_TRANSFER_CHAIN", "LOCATION_TIME_OVERLAP"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH"]

P, O, PH, B, V, L, E = ENTITY_TYPES[0], ENTITY_TYPES[1], ENTITY_TYPES[2], ENTITY_TYPES[3], ENTITY_TYPES[4], ENTITY_TYPES[5], ENTITY_TYPES[6]

#: Which types of source and target an accepted relationship may join.
ENDPOINTS = {
    "CALLED": [(P, P), (P, PH), (PH, PH)],
    "SENT_MONEY_TO": [(P, P), (P, B), (P, O), (B, B), (B, O), (O, B), (O, O), (O, P)],
    "OWNS_VEHICLE": [(P, V), (O, V)],
    "USED_VEHICLE": [(P, V)],
    "WORKS_FOR": [(P, O)],
    "LOCATED_AT": [(P, L), (O, L), (V, L), (E, L), (B, L)],
    "ASSOCIATED_WITH": [(P, P), (P, O), (P, PH), (O, O)],
    "PART_OF_EVENT": [(P, E), (O, E)],
}
