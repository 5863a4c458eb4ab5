"""Which values are examples: distinct texts and owners both count, copies of one document do not."""
from measurekit.llm import secrets

LIVE, COPIED, POPULAR, NAMED = "q8Zr5Tn1Lk9Wp3Xs7Vb2", "b7Yt4Rm2Kc8Qd6Hf1Jg5", "w3Ed9Sx4Za7Pl2Ok6Mn8", "myExampleToken12345678"


def test_copies_of_a_document_keep_its_secret(spark):
    rows = [(i, f"token = {LIVE}", f"s{i}") for i in range(40)]                      # one text, 40 owners
    rows += [(100 + i, f"see {COPIED} in {i}", f"s{i}") for i in range(3)]            # three texts, three owners
    rows += [(200 + i, f"{i} uses {POPULAR}", "one") for i in range(1000)]            # many texts, one owner
    rows += [(2000, f"as {NAMED}", "a"), (2001, f"as {NAMED}", "b"), (2002, f"own {NAMED[::-1]}", "a"), (2003, f"my {NAMED[::-1]}", "a")]
    got = {r["doc_id"]: r["found"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i: [(c["kind"], c["repositories"], c["owners"], c["live"]) for c in got[i]] for i in (0, 1)} == {
        i: [("assign", 1, 40, True), ("generic", 1, 40, True)] for i in (0, 1)}
    assert all(got[i] == [] for i in [*range(100, 103), *range(200, 1200), 2000, 2001])
    assert [c["kind"] for i in (2002, 2003) for c in got[i]] == ["generic", "generic"]
    digest = {r["doc_id"]: (r["n_live"], r["n_example"]) for r in secrets.digest(spark.createDataFrame(
        [(i, f"password={POPULAR} {i}", "one") for i in range(20)], "doc_id long, text string, source string")).collect()}
    assert set(digest.values()) == {(0, 1)}
