"""Patience diff, and the alignment of a pair's shared windows."""

import random

from quernstone.llm import line_dedup
from quernstone.llm.shared import ship

from .test_line_runs import brute, line


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [1, 2, 9, 3, 4]) == [(0, 0), (1, 1), (2, 3), (3, 4)]
    assert line_dedup.patience([5, 1, 2, 6], [7, 2, 1, 8, 2]) in ([(1, 2)], [(2, 1)], [(1, 2), (2, 4)])
    assert line_dedup.patience([], [1]) == []


def pair(earlier, later):
    """Line ranges that the pair deletes, with its windows found here by key."""
    e, d = line_dedup.Lines(earlier), line_dedup.Lines(later)
    first = {}
    for _, h, start, _, core in zip(*line_dedup.windows(e, 10)):
        first.setdefault(h, (int(start), core))
    shared = [(first[h][0], int(a), int(b), first[h][1]) for _, h, a, b, _ in zip(*line_dedup.windows(d, 10)) if h in first]
    return line_dedup.aligned(d, shared, 10)


def test_aligned_blocks():
    a, b, c, p = line("a", 6), line("b", 6), line("c", 6), line("p", 12)
    # One block over several lines, blank ones between included.
    assert set(pair(f"{a}\n\n{b}\n{c}\nx", f"y\n{a}\n\n{b}\n{c}")) >= {(1, 5)}
    # Lines that both have, but with other gaps: no run of ten words.
    assert pair(f"{a}\n\n{b}", f"{a}\n{b}") == []
    # Neighbours in one document only.
    assert pair(f"{a}\n{b}\nx\n{b}\n{c}", f"{b}\n{a}\n{c}\n{b}") == []
    # A repeated passage, which no diff can anchor.
    assert set(pair(f"{p}\nq\n{p}", f"r\n{p}\ns\n{p}\nt")) == {(1, 2), (3, 4)}


def test_windows_are_verified_on_the_lines():
    p, q = line_dedup.Lines(line("p", 12)), line_dedup.Lines(line("q", 12))
    assert line_dedup.aligned(q, [(0, 0, 1, p.core(0, 0))], 10) == []


def test_joined_texts_have_their_own_windows():
    rng = random.Random(7)
    texts = ["\n".join(rng.choice([line("a", 4), line("b", 7), line("c", 11), "", " "]) for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["", "\n\n", "x"]
    ends = [0]
    for t in texts:
        ends.append(ends[-1] + t.count("\n") + 1)
    together = list(zip(*line_dedup.windows(line_dedup.Lines("\n".join(texts)), 10, line_dedup.np.array(ends[1:]))))
    alone = [(k, *w[1:]) for k, t in enumerate(texts) for w in zip(*line_dedup.windows(line_dedup.Lines(t), 10))]
    assert sorted(map(tuple, together)) == sorted(alone)


def test_many_partners_and_edges(spark):
    ship(spark)
    assert line_dedup.BYTES < 60 * 100_000  # the last text is longer than what is read together
    rng = random.Random(2)
    some = lambda: " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, 15)))
    pool = [some() for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, some(), "", " "]) for _ in range(rng.randint(1, 20)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "\n"), (83, rows[5][1]), (84, "\n".join(pool * 40)), (85, "\n" * 3000 + "\n".join(pool)), (86, "\n" * 2000 + "\n".join(pool) + "\n" * 50)]
    long = "\n".join(f"{k} " + "z" * 60 for k in range(100_000))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(90, long, 0), (91, pool[0] + "\n" + long, 0)], "doc_id long, text string, n_words int").coalesce(1)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got.pop(90) == long and got.pop(91).split("\n")[0] in ("", pool[0])
    assert got == brute(rows) and got[83] == ""
    df = df.where("doc_id < 90")
    clash = line_dedup.without_common_lines(df.selectExpr("doc_id", "text", "-5 AS n_words"))
    assert clash.columns == ["doc_id", "text", "n_words"] and {r.n_words for r in clash.collect()} == {-5}


def test_long_document_of_others_passages(spark):
    ship(spark)
    passages = [line(f"s{k}x", 12) for k in range(3000)]
    rows = [*enumerate(passages), (5000, "\n".join(["head", *passages[::-1], "tail"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed_lines, r.n_blocks) for r in line_dedup.dedup_lines(df).collect()}
    assert got.pop(5000) == ("head\ntail", 3000, 1) and got == {i: (t, 0, 0) for i, t in rows[:-1]}
