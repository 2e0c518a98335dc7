import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from matterloom.llm import quality_rules as q

from .helpers import frame, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def brute(rows, limit, left):
    lines, out = {}, []
    norm = lambda x: " ".join(WORD.findall(x)).translate(PLAIN)
    for _, t, s in rows:
        own = {norm(x) for x in (t or "").split("\n")} - {""}
        for x in own:
            lines.setdefault((s, x), set()).add(t)
    for i, t, s in rows:
        t = t or ""
        words = WORD.findall(t)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        real = [x for x in t.split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in real if len(lines[s, norm(x)]) > limit)
        n = len(words)
        failed = n < 50 or 100 * len(covered) > 50 * n
        out.append((i, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(real) - len(set(real)), len(covered), gone, failed, not failed and n - gone >= left * n))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(11)
    common = ["Menu | Home 12", "All rights  reserved.", "menu | HOME 34"]
    rows = [(i, t, r.choice(["a", "b", None])) for i, t in enumerate(texts(30))]
    for i in range(80):
        own = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota".split()) + str(r.randint(0, 999)) for _ in range(20)) for _ in range(r.randint(0, 4))]
        rows.append((100 + i // 2, "\n".join(own + r.choices(common, k=r.randint(0, 3))), r.choice(["a", "b", None])))
    copy = "\n".join(" ".join(f"w{r.randint(0, 10**6)}" for _ in range(30)) for _ in range(4))
    return rows + [(1000 + i, copy, "a") for i in range(30)]


@pytest.mark.parametrize("broadcast", [0, 1, q.BROADCAST])
def test_against_brute_force(spark, broadcast):
    rows = corpus()
    docs = spark.createDataFrame([(*x, "z", 0) for x in rows], "doc_id long, text string, source string, kept string, n_words int")
    got = q.apply_rules(docs, limit=4, broadcast=broadcast).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 4, q.LEFT)
    # Copies count once, so thirty copies of a document keep their lines.
    assert all(r.kept for r in got if r.doc_id and r.doc_id >= 1000)
    clean = q.apply_rules(docs, limit=4, broadcast=broadcast, clean=True)
    assert clean.columns[:3] == ["doc_id", "text", "source"]
    assert not any("rights" in (r.text or "") for r in clean.where("source = 'a' and doc_id between 100 and 999").collect())


def test_sql(spark):
    rows = corpus()
    duckdb.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    got = duckdb.sql(q.rules_sql(limit=4)).project("doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed, base_failed, kept").fetchall()
    assert sorted(got, key=repr) == brute(rows, 4, q.LEFT)


def test_empty_table(spark):
    assert q.apply_rules(frame(spark, ["a"]).limit(0)).collect() == []


def test_a_thousand_documents_of_twelve_shared_lines(spark):
    shared = "\n".join(f"{w} of the template" for w in "abcdefghijkl")
    rows = [(i, f"{shared}\nown {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "a") for i in range(1000)]
    # A document of one line counts like any other; its exact copies count once.
    rows += [(2000 + i, "a of the template", "a") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.documents for r in q.line_documents(docs).where("documents > 1").collect()) == [1000] * 11 + [1001]


def test_documents_that_differ_in_numbers_only_are_distinct(spark):
    lines = [f"{w} of the {w} order" for w in "abcdefghijkl"]
    rows = [(i, "\n".join([*lines, f"Order {10_000 + i} of {i} days, {7 * i} in all"]), "a") for i in range(1000)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # The line of numbers is one line once its digits are alike, unless the numbers' lengths differ.
    got = q.apply_rules(docs, clean=True).collect()
    assert all("order" not in r.text for r in got if r.text)
    assert sorted(r.documents for r in q.line_documents(docs).collect())[-12:] == [1000] * 12


def test_very_long_text(spark):
    r = random.Random(3)
    text = "\n".join(" ".join(f"w{r.randint(0, 10**5)}" for _ in range(9)) for _ in range(50_000))
    rows = [(1, text, "a"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((tuple(x) for x in q.apply_rules(docs).collect()), key=repr) == brute(rows, q.LIMIT, q.LEFT)


def test_documents_that_share_lines_are_distinct(spark):
    # Twenty hosts of sixty documents that share k lines and have one of their own; each document stands twice.
    rows = []
    for k in (3, 10):
        for host in range(20):
            shared = [f"{w} shared by all of host" for w in "abcdefghij"[:k]]
            for i in range(60):
                own = " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for w in ("own", "line", "of", "document"))
                rows += [(len(rows), "\n".join([*shared, own]), f"{k}-{host}")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r.documents for r in q.line_documents(docs).where("documents > 1").collect()] == [60] * (20 * 13)
    assert {r.n_removed - 6 * int(r.source.split("-")[0]) for r in q.apply_rules(docs, clean=True).collect()} == {0}
