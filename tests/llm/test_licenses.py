import re

from credsweep.llm import licenses

from .conftest import make_docs


def shingles(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return w, [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def brute(rows, templates):
    """Windows of every template over every text."""
    out = {}
    for i, t, _ in rows:
        _, s = shingles(t)
        for name, notice in templates:
            w, p = shingles(notice)
            step, parts = max(1, len(w) // 4), set(p)
            for b in range(0, len(s), step):
                share = len(parts & set(s[b:b + len(w) - 4 + step])) / len(parts)
                if share >= 0.8:
                    best, first, begins = out.get((i, name), ((0, 0, ""), 10**9, set()))
                    out[i, name] = max(best, (share, len(w), notice)), min(first, b), begins | {b}
    return {k: (v[0][2], v[0][0], v[1], len(v[2])) for k, v in out.items()}


def as_dict(df):
    return {(r["doc_id"], r["license"]): (r["template"], r["containment"], r["first_word"], r["n_windows"]) for r in df.collect()}


ALL = [(name, t) for name, texts in licenses.TEMPLATES.items() for t in texts]


def test_notices_within_texts(spark, tricky_rows):
    rows = [r for r in tricky_rows if r[0] not in (3, None)]
    filler = [t for _, t, _ in rows if t and len(t) > 300]
    for k, (_, notice) in enumerate(ALL):
        w = notice.split()
        worn = " ".join(x for j, x in enumerate(w) if j != len(w) // 2)
        rows += [(1000 + k, filler[k % len(filler)] + "\n" + notice.upper() + "\n" + filler[0], "s"), (2000 + k, worn, "s"), (3000 + k, " ".join(w[:len(w) // 2]), "s")]
    assert as_dict(licenses.scan(make_docs(spark, rows))) == brute(rows, ALL)


def test_own_templates_and_long_ones(spark):
    long = " ".join(f"clause{i} of this agreement" for i in range(300))
    templates = spark.createDataFrame([("Own", long, 1), ("Short", "only four words here", 2), ("Null", None, 3)], "license string, text string, length int")
    rows = [(1, "before " * 50 + long, "s"), (2, long[:len(long) // 2], "s"), (3, None, "s"), (4, "", "s"), (5, long.replace("clause7 ", "article7 "), "s")]
    assert as_dict(licenses.scan(make_docs(spark, rows), templates)) == brute(rows, [("Own", long)])


def test_edges(spark, tricky, empty):
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(tricky).count() == 0
    none = spark.createDataFrame([], "license string, text string")
    assert licenses.scan(tricky, none).count() == 0
    plan = licenses.scan(tricky)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    twice = make_docs(spark, [(7, "Released under the MIT License.", "s")] * 2)
    assert [(r["doc_id"], r["license"], r["containment"]) for r in licenses.scan(twice).collect()] == [(7, "MIT", 1.0)]
