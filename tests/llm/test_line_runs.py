"""Line dedup against a brute force over all earlier documents."""

import random

from quernstone.llm import line_dedup
from quernstone.llm.shared import ship


def brute(rows, min_words=10):
    """doc_id -> remaining text: no run of ``min_words`` words that any earlier document has."""
    seqs = {i: [x.strip() if x.split() else b"" for x in (t or "").encode().split(b"\n")] for i, t in rows}
    out = {}
    for i, t in rows:
        later, gone = seqs[i], set()
        size = [len(x.split()) for x in later]
        solid = {x: len(x.split()) for x in later if x}
        for e in (e for e in seqs if e < i and any(x in solid for x in seqs[e])):
            before = [0] * (len(later) + 1)
            for x in seqs[e]:
                now = [0] * (len(later) + 1)
                for j, y in enumerate(later):
                    if x == y:
                        now[j + 1] = before[j] + 1
                        if sum(size[j + 1 - now[j + 1] : j + 1]) >= min_words:
                            gone |= set(range(j + 1 - now[j + 1], j + 1))
                before = now
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t
    return out


def dedup(spark, rows):
    ship(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}


def line(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def test_block_of_lines_with_other_first_holders(spark):
    a, b = line("a", 9), line("b", 9)
    rows = [(1, a), (2, b), (3, f"{a}\n{b}"), (4, f"own\n{a}\n{b}\nend")]
    got = dedup(spark, rows)
    assert got == brute(rows)
    assert got[3] == rows[2][1] and got[4] == "own\nend"


def test_random_documents(spark):
    rng = random.Random(5)
    pool = [line(f"p{k}x", rng.randint(1, 7)) for k in range(8)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 15)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n"), (63, "\n\n" + rows[3][1] + "\n"), (64, "\n\n" + rows[3][1] + "\n")]
    got = dedup(spark, rows)
    assert got == brute(rows) and got[64] == ""


def test_repeated_ids_and_edges(spark):
    text = line("t", 12)
    ship(spark)
    df = spark.createDataFrame([(1, text), (1, text), (1, "x"), (None, text), (2, text)], "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text) for r in line_dedup.without_common_lines(df).collect())
    assert kept == sorted([("1", text), ("1", text), ("1", "x"), ("None", text)])
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_passages_in_other_order_and_held_twice(spark):
    p, q, r = line("p", 12), line("q", 12), line("r", 60)
    rows = [(1, f"{p}\nx\n{q}"), (2, f"y\n{q}\nz\n{p}\nv"), (3, f"c\n{r}\nd\n{r}\ne"), (4, f"f\n{r}\ng"), (5, f"h\n{r}\ni\n{r}\nj")]
    got = dedup(spark, rows)
    assert got == brute(rows)
    assert got[2] == "y\nz\nv" and got[4] == "f\ng" and got[5] == "h\ni\nj"


def test_block_in_more_than_a_thousand_documents(spark):
    a, b, c = line("a", 9), line("b", 9), line("c", 9)
    block = f"{a}\n{b}\n{c}"
    rows = [(1, a), (2, b), *((i, block) for i in range(3, 1100))]
    assert dedup(spark, rows) == {1: a, 2: b, 3: block, **{i: "" for i in range(4, 1100)}}


def test_lines_of_one_or_two_words(spark):
    words = "\n".join(f"w{k}" for k in range(12))
    cells = "\n".join(f"日本{k} 語" for k in range(6))
    rows = [(1, words), (2, words), (3, cells), (4, f"head\n{cells}\nend")]
    got = dedup(spark, rows)
    assert got == brute(rows) and got[2] == "" and got[4] == "head\nend"
