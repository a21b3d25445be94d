from pyspark.sql import functions as F

from quern.functions import payloads as P


def test_payloads_of_any_shape(rows):
    table = rows(
        "id int, p string, ok boolean",
        (1, '{"b": {"x": [1, 2.5, null]}, "a": "é"}', True), (2, '{"a": 1', True), (3, "{broken}", True), (4, "words", False), (5, None, True), (6, "[1, 2]", None),
        (7, "{}", True), (8, '{"ok": "old", "a": null}', False), (9, "", True), (10, '{"a": 3}', None), (11, "12", True),
    )
    plain = {r.id: r.s for r in table.select("id", P.stamped(F.col("p"), ok=F.col("ok")).alias("s")).collect()}
    assert plain == {
        1: '{"a":"é","b":{"x":[1,2.5,null]},"ok":true}', 2: '{"a": 1', 3: "{broken}", 4: "words", 5: None, 6: "[1, 2]", 7: '{"ok":true}', 8: '{"a":null,"ok":false}',
        9: "", 10: '{"a":3}', 11: "12",
    }
    wrapped = {r.id: r.s for r in table.select("id", P.stamped(F.col("p"), "raw", ok=F.col("ok")).alias("s")).collect()}
    changed = {2: '{"raw":"{\\"a\\": 1","ok":true}', 4: '{"raw":"words","ok":false}', 6: '{"raw":"[1, 2]"}', 9: '{"raw":"","ok":true}', 11: '{"raw":"12","ok":true}'}
    assert wrapped == plain | changed
    got = {r.id: (r.a, r.x) for r in table.select("id", P.extracted(F.col("p"), "$.a", "long").alias("a"), P.extracted(F.col("p"), "$.b.x[1]", "double").alias("x")).collect()}
    assert got[10] == (3, None) and got[1] == (None, 2.5) and got[2] == got[5] == got[4] == (None, None)
