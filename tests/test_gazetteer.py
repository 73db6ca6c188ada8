import random

from lodgely.operators import gazetteer as G
from pyspark.sql import functions as F

NAMES = ["Bình Thạnh", "Gò Vấp", "Tân Bình", "Phú Nhuận", "Thủ Đức", "Quận 1", "Bình Tân", "Hoàn Kiếm", "Cầu Giấy", "Huế"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_misspelt_names_are_found(spark):
    rng, rows = random.Random(6), []
    for k in range(400):
        name = rng.choice(NAMES)
        wrong = list(name)
        if len(name) > 4 and k % 4:
            at = rng.randrange(len(wrong))
            wrong[at : at + 1] = rng.choice([[], [wrong[at], wrong[at]], ["x"]])
        rows.append((k, name, rng.choice(["Quận ", "gần ", ""]) + "".join(wrong) + rng.choice([" N Nguyen Văn Quý 3 tin", ", TP. HCM", ""])))
    places = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "alias string, place_no int")
    got = {r.k: r.alias for r in G.find_places(spark.createDataFrame(rows, "k int, name string, text string"), "k", "text", places).collect()}
    assert sum(got.get(k) == n for k, n, _ in rows) >= 0.9 * len(rows) and sum(got.get(k, n) != n for k, n, _ in rows) <= 0.05 * len(rows)


def test_against_all_spans(spark):
    rng = random.Random(2)
    words = ["tan", "binh", "thanh", "tank", "bin", "go", "vap", "vat", "phu", "nhuan", "hue"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))) for k in range(150)] + [(900, None)]
    names = ["tan binh", "binh thanh", "go vap", "phu nhuan", "hue", "tan"]
    want = {}
    for k, t in rows:
        w = (t or "").split()
        found = []
        for i in range(len(w)):
            for n in range(1, min(4, len(w) - i) + 1):
                for name in names:
                    d = distance(" ".join(w[i : i + n]), name)
                    if d <= (0 if len(name) <= 3 else 1 if len(name) <= 7 else 2):
                        found.append((-len(name), d, i, name, n))
        if found:
            _, d, i, name, n = min(found)
            want[k] = (name, d, i, n)
    got = G.find_places(spark.createDataFrame(rows, "k int, t string"), "k", "t", spark.createDataFrame([(n,) for n in names], "alias string"))
    assert {r.k: (r.alias, r.edits, r.start, r.words) for r in got.collect()} == want and len(want) > 50
    assert G.find_places(spark.createDataFrame(rows, "k int, t string"), "k", "t", spark.createDataFrame([], "alias string")).count() == 0
