from collections import Counter

import duckdb
from lodgely.llm import quality as Q


def cut(text):
    return [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]


def plain(text):
    """The contract's figures of a text, in their plain form: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = cut(text)
    lines = [x for x in text.split("\n") if cut(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def test_query_by_brute_force(odd, docs, none):
    for table in (odd, docs):
        want = sorted(((r.doc_id, *plain(r.text)) for r in table.collect()), key=str)
        got = Q.op13_rules(table).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == want
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert Q.op13_rules(none).count() == 0


def test_query_by_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{sf}/documents.parquet'")
    got = con.execute(Q.ORACLE_SQL)
    names = [c[0] for c in got.description]
    want = sorted(got.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in Q.op13_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect()) == want


def test_repeated_windows_at_the_edges():
    import numpy as np

    for words in ([], [1] * 5, [1] * 6, [1, 2, 3, 4, 5] * 2, [1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5], [1, 2, 3, 4] * 2, list(range(50)) + list(range(7))):
        assert Q._repeat_words(np.array(words, np.int64)) == plain(" ".join(map(str, words)))[4]


def test_clean_documents_are_kept(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = Q.op13_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").collect()
    assert all(r.kept for r in got if r.quality == 1 and not r.base_failed)
    assert sum(r.kept for r in got if r.quality == 0) <= 0.05 * sum(r.quality == 0 for r in got)


def test_policies_and_ablations(spark):
    rules = (Q.Rule(0, "a", "n_words < 2"), Q.Rule(3, "b", "n_symbols > 0"), Q.Rule(62, "c", "n_digits > 0"))
    docs = spark.createDataFrame([("x", "one"), ("x", "one #"), ("y", "1 2 #"), ("y", "fine text"), ("y", "#"), (None, None)], "source string, text string")
    rows = Q.ledger(docs, rules)
    assert sorted(r.failed for r in rows.collect()) == sorted([1, 8, 8 | 1 << 62, 0, 9, 1])
    strict, mild = Q.Policy("s", ("a", "b", "c")), Q.Policy("m", ("a",), ("b", "c"), 2)
    for policy in (strict, mild):
        assert sorted(r.text or "" for r in rows.filter(Q.kept(policy, rules=rules)).collect()) == (["fine text"] if policy is strict else ["fine text", "one #"])
        for by in ((), ("source",)):
            for r in Q.ablations(rows, policy, by, rules).collect():
                less = Q.Policy("less", tuple(x for x in policy.reject if x != r.rule), tuple(x for x in policy.doubt if x != r.rule), policy.most)
                own = rows.filter(rows["source"].eqNullSafe(r.source)) if by else rows
                count = lambda df: (df.count(), sum(x.n_words for x in df.collect()))
                assert (r.rows, r.words) == count(own) and (r.kept_rows, r.kept_words) == count(own.filter(Q.kept(policy, rules=rules)))
                assert (r.without_rows, r.without_words) == count(own.filter(Q.kept(less, rules=rules)))
                assert (r.failed_rows, r.failed_words) == count(own.filter(own["failed"].bitwiseAND(Q.mask((r.rule,), rules)) != 0))
    spread = {r.source: (r.some_fail, r.all_fail) for r in Q.rule_spread(rows, ("source",)).collect()}
    assert spread == {"x": (9, 0), "y": (9 | 1 << 62, 0), None: (1, 1)}
    assert {r.text: r["names"] for r in rows.select("text", Q.failed_rules(rules=rules).alias("names")).collect()}["1 2 #"] == ["b", "c"]


def test_long_texts_and_clashing_columns(spark):
    text = " ".join(f"w{i % 5003}" for i in range(900_000))
    docs = spark.createDataFrame([(1, text, 5, 6, "z")], "doc_id long, text string, n_words int, failed int, note string")
    r = Q.ledger(docs).first()
    assert (r.n_words, r.n_repeat_words, r.note, r.text == text, r.failed) == (900_000, 900_000, "z", True, 2 + 256)
