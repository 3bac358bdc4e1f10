"""IBANs with other words, numbers and IBANs beside them."""

from lakewarden.llm import pii

DE, GB, NO = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"


def test_iban_ends_where_its_country_says(spark):
    cases = [
        (f"IBAN {DE} BIC COBADEFFXXX", [DE]), ("DE89370400440532013000 BIC COBADEFFXXX", ["DE89370400440532013000"]), (f"é {DE} I paid", [DE]), (f"{DE} {GB} {NO}", [DE, GB, NO]),
        (f"{DE} 12 34", [DE]), (f"AT12 {DE}", [DE]), (f"{DE}X and {DE[:-1]}1", []), (f"{DE}.", [DE]), (DE, [DE]), (f"x{DE}", []), ("A" * 5000 + f" {GB} " + "7 " * 3000 + NO, [GB, NO]), ("", []), (None, []),
    ]
    found = pii.find_pii(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: [cases[r["doc_id"]][0][s["start"]: s["end"]] for s in r["iban"]] for r in found} == {i: w for i, (_, w) in enumerate(cases)}
