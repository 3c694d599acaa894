"""Line-first quality rules: counts against a plain version, verdicts against labels, edges."""

import re

from quernstone.llm import quality
from quernstone.llm.shared import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed)


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_documents(spark):
    ship(spark)
    d = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{d}/documents.parquet")
    got = {r.doc_id: r for r in quality.assess(df.select("doc_id", "text")).collect()}
    for r in df.collect():
        assert counts(got[r.doc_id]) == plain(r.text)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = [(q, got[i].kept) for i, q in labels.items() if not got[i].base_failed]
    assert sum(bool(q) == kept for q, kept in judged) >= 0.97 * len(judged)


def test_edges(spark):
    ship(spark)
    prose = ". ".join(f"Alpha{i} beta{i} gamma{i}, delta{i} went{i} home{i} with{i} care{i}" for i in range(20)) + "."
    rows = [(1, None, 0), (2, "", 0), (3, " \n   ", 0), (4, prose, 0), (4, prose, 0), (5, prose + "\n" + "Home | News | About | Contact\n" * 2, 7), (6, "a b c " * 100_000, 0), (None, prose, 0), (7, "word #$% é " * 30, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = quality.assess(df, with_text=True).collect()
    assert [counts(r) for r in sorted(got, key=str)] == [counts_of for _, counts_of in sorted(((str(r), plain(r.text)) for r in got))]
    kept = {r.doc_id: r.kept for r in got}
    assert kept == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False, None: True, 7: False}
    clean = quality.clean(df)
    assert clean.columns == df.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[5].strip() == prose and set(texts) == {4, 5, None}
    assert clean.where("doc_id = 5").first().kept == 7
    assert quality.assess(df.limit(0)).collect() == []


def fails(line, edge=False):
    return quality.line_fails(line, line.encode().split(), edge=edge)


def test_each_rule():
    prose = "It was late, and the last of them had gone home by then."
    assert fails(prose) == fails(prose, edge=True) == ""
    assert fails("w#$% o*&| r<<>> d##") == "symbols" and fails("Rent is $900 a month, paid early.") == ""
    for line in ("Home » News » About us", "Home · News · Contact · Help", "Start › Produkte › Schuhe", "one / two / three / four", "ホーム → 製品 → 会社"):
        assert fails(line) == "navigation"
    assert fails("• a list item of some words") == fails("He stayed – as always – until the very last of the guests had left.") == ""
    assert fails("https://example.org/a/b/c?d=e see") == "links" and fails("[top](https://example.org/top/of/the/page)") == "links"
    assert fails("See https://a.org for the whole report, which was published by the council last year.") == ""
    assert fails("BUY!! NOW!! AND!! SAVE!! A!! LOT!! OF!! CASH!!") == "shouting" and fails("Stop! Who is there, at this hour of the night, and why!") == ""
    assert fails("la " * 20) == "repetition" and fails("the cat and the dog and the bird and the fish, all of the house") == ""
    assert fails(" ".join(f"word{k}" for k in range(30))) == "punctuation" and fails(" ".join(f"word{k}" for k in range(29))) == ""
    assert fails("語" * 120) == "punctuation" and fails("語" * 60 + "。" + "語" * 60) == "" and fails("語" * 119) == ""
    assert fails("Alle Rechte vorbehalten.") == fails("ALL RIGHTS RESERVED") == fails("Tous droits réservés") == "boilerplate"
    assert fails("The law on privacy policy was debated for years, " + prose + " " + prose) == ""
    assert fails("© 2019 Example", edge=True) == "boilerplate" and fails("© 2019 Example") == "" and fails("A ™ in a long line. " + prose + " " + prose, edge=True) == ""


def test_verdict_follows_the_words_on_failed_lines():
    good = "\n".join(" ".join(f"w{k}x{j}" for j in range(10)) + "." for k in range(6))
    bad = "\n".join(" | ".join(f"h{k}y{j}" for j in range(6)) for k in range(5))  # 11 words a line
    assert quality.judge(f"{good}\n{bad}")["kept"] and quality.judge(f"{good}\n{bad}")["cleaned"] == good
    found = quality.judge("\n".join(good.split("\n")[:5]) + "\n" + bad)
    assert not found["base_failed"] and not found["kept"] and (found["n_words"], found["words_kept"], found["n_failed_lines"]) == (105, 50, 5)
    again = quality.judge(f"{good}\n{good}")
    assert again["n_dup_lines"] == 6 and again["base_failed"]
    # A legal mark goes at the foot and stays in the middle.
    marked = good.split("\n")
    assert quality.judge("\n".join([*marked, "© 2020 A. B."]))["cleaned"] == good
    inner = "\n".join([*marked[:3], "© 2020 A. B.", *marked[3:]])
    assert quality.judge(inner)["cleaned"] == inner


def test_sql_agrees_on_odd_lines():
    """The rules, written twice, on lines near each rule's edge."""
    import random

    import duckdb

    from quernstone.llm.queries import ORACLE_SQL

    rng = random.Random(4)
    parts = ["©", "(c) 2020 X", "Copyright", "a | b | c", "›", "»", "—", "word", "Wörter", "語" * 60, "。", "!", "！", "!!", "http://a.b/c", "www.x.org", "<b>", "</a>", "](/x)", "[t](u)", "#", "$5", "the", "the", "Impressum", "alle Rechte VORBEHALTEN", "privacy policy", "x.", "\u00a0", "\x0b", "\u2028", "\r", "…"]
    rows = [(k, "\n".join(rng.choice([" ", "  "]).join(rng.choice(parts) for _ in range(rng.choice([1, 2, 4, 8, 12, 20, 30, 33]))) for _ in range(rng.randint(1, 9)))) for k in range(800)]
    rows += [(800, None), (801, ""), (802, "\n \n")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cols = [*quality.COUNTS, "base_failed", "kept"]
    got = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, {', '.join(cols)} FROM ({ORACLE_SQL['op9_quality']})").fetchall()}
    found = {i: tuple(quality.judge(t)[c] for c in cols) for i, t in rows}
    assert got == found and sum(x[-1] for x in found.values()) > 20
