import pytest

from vinculum.operators.quantities import normalise_amounts, same_sum_pairs, unit_table

UNITS = [("INR", ["₹", "Rs"], 100), ("USD", ["US$", "$"], 8325), ("EUR", ["€"], 9050), ("JPY", ["¥"], 56), ("NPR", ["NRs"], 62)]
TEXTS = {
    "Rs 1,02,000.00": 10_200_000, "₹23,23,680/- only": 232_368_000, "INR9,900.50": 990_050, "Rs. 0.01 lakh": 100_000, "9.99 lac only": 99_900_000, "₹ 9.7L": 97_000_000,
    "1 thousand": 100_000, "Rs 994.3 K": 99_430_000, "1049k": 104_900_000, "0.048k JPY": 2_688, "976.250,00 JPY": 54_670_000, "1.047.500,00 JPY": 58_660_000, "105,00 EUR": 950_250,
    "EUR 1,100.00": 9_955_000, "USD 184.00": 1_531_800, "₹3.0408cr": 3_040_800_000, "6.95 crores only": 6_950_000_000, "Rs 1,10,00,000": 1_100_000_000,
    "rupees one thousand only": 100_000, "Rupees Twenty-Seven Lakh Fifty Thousand Only": 275_000_000, "thirty-one thousand seven hundred rupees": 3_170_000,
    "rupees two thousand eight hundred twenty-three crore sixty lakh only": 2_823_600_000_000 * 1, "six hundred rupees": 60_000, "N/A": None, "-": None, "12 apples": None, "INR 5 USD 7": None,
}


def run(spark, rows):
    df = spark.createDataFrame(rows, "k int, amount double, amount_text string, currency string, paise string")
    units = spark.createDataFrame(UNITS, "code string, symbols array<string>, paise_per_unit bigint")
    return normalise_amounts(df, units)


def test_texts_state_number_and_unit(spark):
    TEXTS["rupees two thousand eight hundred twenty-three crore sixty lakh only"] = (2823 * 10**7 + 60 * 10**5) * 100
    got = {r.amount_text: r.paise for r in run(spark, [(k, 5.0, t, "USD", "x") for k, t in enumerate(TEXTS)]).collect()}
    assert {t: None if p is None else int(p) for t, p in got.items()} == TEXTS


@pytest.mark.parametrize(
    "amount,unit,paise",
    [(10.5, None, 1050), (10.5, " inr ", 1050), (105.0, "PAISE", 105), (105.0, "INR paise", 105), (400.0, "INR '000", 40_000_000), (2.97, "LAKHS", 29_700_000), (2.0, "INR crore", 2_000_000_000), (850.0, "$", 7_076_250),
     (298.0, "NRs", 18_476), (3.0, "US$", 24_975), (5.0, "shells", None), (0.0, "INR", 0), (-7.25, "INR", -725), (float("nan"), "INR", None), (float("inf"), None, None), (None, "INR", None), (5.0, "", 500)],
)
def test_amounts_count_in_their_unit(spark, amount, unit, paise):
    r = run(spark, [(1, amount, None, unit, "x"), (2, amount, "  ", unit, "x")]).collect()
    assert [None if x.paise is None else int(x.paise) for x in r] == [paise, paise]


def test_rows_without_unit_get_a_posterior_and_misfits_are_flagged(spark):
    rows = [(k, 10_000.0 + 37 * k, None, "INR", None) for k in range(400)] + [(1000 + k, 11_000.0 + 10 * k, None, None, None) for k in range(40)] + [(2000, 1_150_000.0, None, None, None)]
    got = {r.k: r for r in run(spark, rows).collect()}
    assert len(got) == len(rows)
    assert got[0].unit_posterior is None and got[1005].unit_posterior > 0.9 and got[1005].unit_uncertain is False
    assert got[2000].unit_uncertain is True


def test_the_unit_of_a_bare_number_is_recovered(spark):
    import random

    r = random.Random(4)
    sums = [10 ** r.gauss(5.0, 0.25) for _ in range(900)]
    rows = [(k, x, None, "INR", None) for k, x in enumerate(sums[:700])]
    rows += [(10_000 + k, x, None, None, None) for k, x in enumerate(sums[700:800])]  # in rupees
    rows += [(20_000 + k, x / 1e5, None, None, None) for k, x in enumerate(sums[800:])]  # in lakhs
    got = {x.k: x for x in run(spark, rows).collect()}
    plain, lakhs = [got[k] for k in got if 10_000 <= k < 20_000], [got[k] for k in got if k >= 20_000]
    assert sum(x.unit_assigned == 1 for x in plain) >= 98 and sum(x.unit_assigned == 100_000 for x in lakhs) >= 98
    assert all(x.paise_assigned == x.paise * 100_000 for x in lakhs if x.unit_assigned == 100_000)
    assert sum(x.unit_uncertain for x in plain) <= 4 and all(x.unit_uncertain for x in lakhs if x.unit_assigned != 1) and got[0].unit_assigned is None and got[0].paise_assigned == got[0].paise


def test_very_large_amounts_are_readable(spark):
    rows = [(1, 1e19, None, "INR", None), (2, 3e25, None, None, None), (3, 1e37, None, "INR", None), (4, 1e30, None, "INR crore", None), (5, -2e20, None, "PAISE", None)]
    got = {r.k: (None if r.paise is None else int(r.paise), r.amount_source) for r in run(spark, rows).collect()}
    assert got[1] == (10**21, "column") and got[2][0] == 3 * 10**27 and got[3] == (None, "unreadable") and got[4] == (None, "unreadable") and got[5][0] == -2 * 10**20


def test_empty_tables_and_bounds(spark):
    assert run(spark, []).count() == 0
    units = spark.createDataFrame(UNITS, "code string, symbols array<string>, paise_per_unit bigint")
    with pytest.raises(ValueError):
        unit_table(units, most=2)


def test_pairs_written_differently(spark):
    rows = [(1, "r", 5, "a"), (2, "r", 5, "b"), (3, "r", 5, "a"), (4, "r", 6, "c"), (5, None, 5, "d"), (6, "q", 7, None), (7, "q", 7, "x"), (8, "p", 1, None), (9, "p", 1, None)]
    df = spark.createDataFrame(rows, "k int, rec string, paise long, t string")
    assert {tuple(r) for r in same_sum_pairs(df, "rec", "k", ["t"]).collect()} == {(1, 2), (2, 3), (6, 7)}
