"""Orders played one by one, the SQL twin, path counts, odd rows."""

import random
import re
from itertools import permutations
from math import factorial

import duckdb

from driftloom.llm.filteraudit import Lattice, audit_filters
from driftloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def played(docs, labels):
    """Every order applied filter by filter to the documents."""
    good, toxic = ({i for i, *x in labels if i is not None and x[at] == 1} for at in (0, 1))
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids = [j for j, other, _ in docs if (other or "") == text and j is not None]
        late = bool(ids) if i is None else any(j < i for j in ids)
        capitals = sum("A" <= c <= "Z" for c in text)
        bad = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), bool(set("#$%&*|") & set(text)), late]
        fails.append((i, source or "", {f for f, x in zip("ABCDE", bad) if x}))
    out = []
    for part in {p for _, p, _ in fails}:
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [(i, x) for i, p, x in fails if p == part]
            whole = left
            for step, f in enumerate(order, 1):
                gone, left = [(i, x) for i, x in left if f in x], [(i, x) for i, x in left if f not in x]
                total[f] += len(gone)
                count = [len(left), len(gone), sum(f in x for _, x in whole) - len(gone), sum(x == {f} for _, x in whole), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                rows.append((part, "".join(order), step, *count))
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(SQL["op12_filter_audit"])
    out = QUERIES["op12_filter_audit"](spark, SF)
    assert out.columns == [c[0] for c in want.description]
    rows = out.collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
    assert len(rows) == 600 * len({r.part for r in rows})


def test_paths():
    for n in (1, 3, 5):
        lattice = Lattice(n)
        assert lattice.forward == [factorial(s.bit_count()) for s in range(1 << n)]
        assert lattice.backward == [factorial(n - s.bit_count()) for s in range(1 << n)]
        assert lattice.weight.sum() == n * factorial(n)  # each order takes n edges


def test_equals_orders_played(spark):
    rng = random.Random(7)
    words = ["aa", "Bb", "c#", "ddé", "E", " x", "ff"]
    texts = [" \x0b".join(rng.choice(words[: rng.randrange(1, 8)]) for _ in range(rng.randrange(190, 210))) for _ in range(12)]
    texts += [" ".join(f"w{rng.randrange(300)}" for _ in range(260)) for _ in range(6)] + ["", None, " \t\n", "one\fTwo", "x" * 50_000 + " $"]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["s", "t", "", None])) for _ in range(120)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    df = spark.createDataFrame([(*d, "p", 1, 2) for d in docs], SCHEMA + ", part string, mask int, n int").repartition(5)
    out = audit_filters(df, spark.createDataFrame([(*x, "q") for x in labels], LABELS + ", part string"))
    assert sorted(map(tuple, out.collect())) == played(docs, labels)


def test_no_documents_and_no_labels(spark):
    docs, labels = spark.createDataFrame([(1, "a", None)], SCHEMA), spark.createDataFrame([], LABELS)
    assert sorted(map(tuple, audit_filters(docs, labels).collect())) == played([(1, "a", None)], [])
    assert audit_filters(docs.limit(0), labels).collect() == []
