from vinculum.llm import addresses as A

ONE = [
    "Shop 9/2, Silverbay Complex, Gulmira Road, Zoharvanpet Market, Varunapatti 099120",
    "099120; Varunapatti; Zoharvanpet Mkt.; Gulmira Road; Silverbay Compl.; Shop 9/2",
    "shp 9/2, gulmria road, nr. clock tower, zoharvanpet market, varunapatti - 099120",
    "SHOP NO. 9-2, GULMIRA RD., ZOHARVANPET MARKET, 099120",
    "Zoharvnpet Market, Gulmira Road, Shop 9 / 2, Varunapatti PIN 099 120",
    "Silverbay Cplx Sh. No. 9/2 Gulmira Rd Zoharvanpet Mkt Varunapatti",
]
TWO = ["House No 119, Tamari Lane, Seshtitaganj Layout, Jhirnapur 100148", "#119; Tsmari Gali; Seshtitaganj L/O; Jhirnapur; - 100148", "H No 119 Tamari Ln. Opp. Old Bus Stand Seshtitaganj Lay out Jhirnapur"]
OTHERS = [
    "Shop 9/3, Silverbay Complex, Gulmira Road, Zoharvanpet Market, Varunapatti 099120", "Flat 9/2, Silverbay Complex, Gulmira Road, Zoharvanpet Market, Varunapatti 099120",
    "House No 119, Tamari Marg, Seshtitaganj Layout, Jhirnapur 100148", "House No 119, Tamari Lane, Seshtitaganj Layout, Jhirnapur 100149",
]
NONE = [None, "", "  ", "-", "UNKNOWN", "N/A", "CELL-1-10000", "somewhere near the bridge"]


def groups(spark, rows):
    df = spark.createDataFrame([(x, "other") for x in rows], "loc string, place string")
    out = {}
    for r in A.link_addresses(df).collect():
        out.setdefault(r.place, []).append(r.loc)
    return sorted(map(sorted, out.values()))


def test_writings_of_a_place_meet_and_other_numbers_do_not(spark):
    got = groups(spark, ONE + TWO + OTHERS + NONE + ONE)
    assert got == sorted([sorted(ONE), sorted(TWO), *[[x] for x in OTHERS]])


def test_empty_and_odd_tables(spark):
    assert groups(spark, []) == [] == groups(spark, NONE)
    long = "Shop 5, " + "x" * 20_000 + " Road, Abcd Nagar, Efgh 100100"
    assert groups(spark, [long, long]) == [[long]]


def test_distance_counts_a_transposition_once():
    assert A.osa("tamari", "tmaari", 2) == 1 and A.osa("tamari", "tamari", 2) == 0
    assert A.osa("abc", "xyz", 2) == 3 and A.osa("ab", "abcdef", 2) == 3


def test_common_names_that_look_alike_are_two_places():
    x, y = A.parse(TWO[0]), A.parse(TWO[0].replace("Tamari", "Kamari"))
    assert A.same_address(x, y, lambda *_: False) and not A.same_address(x, y, lambda *_: True)
