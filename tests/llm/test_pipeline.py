import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from matterloom.llm import byte_bpe, mixing, quality_rules

from .test_jaccard_join import brute as jaccard_brute
from .test_jaccard_join import shingles
from .test_quality_rules import brute as rules_brute

HOME = "Home | About | Contact us and read the terms"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(8)
    plain = ["".join(r.choice(["ta", "ri", "mo", "len", "su", "ka"]) for _ in range(r.randint(2, 5))) for _ in range(2500)]
    bad = ["gruxa", "gruxe", "vile", "filth", "gruxor"]
    rows, toxic = [], {}
    for i in range(500):
        lines = [" ".join(r.choices(plain, k=r.randint(8, 30))) for _ in range(r.randint(1, 7))]
        if r.random() < 0.3:
            lines.insert(0, HOME)
        if r.random() < 0.25:
            toxic[i] = 1
            lines = [x + " " + " ".join(r.choices(bad, k=2)) for x in lines]
        elif i % 3:
            toxic[i] = 0
        rows.append((i, "\n".join(lines), "en", r.choice(["a", "a", "b", None]), None))
    for i in range(500, 560):
        rows.append((i, rows[r.choice([3, 5, 8, 13])][1] + r.choice(["", " end"]), "en", "a", 1))
    return rows + [(900, None, None, None, None), (901, "", None, None, 0)], toxic


def test_stages(spark, tmp_path):
    rows, toxic = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        assert k == 4 or docs.columns == list(corpus_pipeline.COLUMNS)
    ruled, clean, single, mixed, coded = seen

    want = {r[0] for r in rules_brute([(i, t, s) for i, t, _, s, _ in rows], quality_rules.LIMIT, quality_rules.LEFT) if r[-1]}
    assert {r.doc_id for r in ruled} == want and not any(HOME in r.text.split("\n") for r in ruled if r.source == "a")

    kept = {r.doc_id for r in clean}
    right = [(i in kept) == (toxic[i] == 0) for i in want if i in toxic]
    held = [(i in kept) == (toxic[i] == 0) for i in want if i in toxic and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(right) > 0.97 and np.mean(held) > 0.95

    groups = jaccard_brute([(r.doc_id, r.text) for r in clean])
    assert {r.doc_id for r in single} == {c for _, _, c in groups} and len(single) == len({r.doc_id for r in single}) < len(clean)

    size = {r.doc_id: len(r.text.split()) for r in single}
    source = {r.doc_id: r.source for r in single}
    whole, taken = Counter(), Counter()
    for i, n in size.items():
        whole[source[i]] += n
    for r in mixed:
        taken[source[r.doc_id]] += size[r.doc_id]
    aims = mixing.targets([whole["a"], whole["b"], whole[None]])
    for s, aim in zip(("a", "b", None), aims, strict=True):
        assert abs(taken[s] - aim) <= 60
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3

    code = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in single}
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in mixed)
    for r in coded:
        ids = code.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(r.doc_id for r in coded)


def near_groups(texts):
    """Groups of texts by brute force, linked at a similarity of 0.8 of their five-word shingles."""
    sets, groups = [shingles(t, 5) for t in texts], []
    for k, s in enumerate(sets):
        met = [g for g in groups if any(s and 5 * len(s & sets[j]) >= 4 * len(s | sets[j]) for j in g)]
        groups = [g for g in groups if g not in met] + [{k}.union(*met)]
    return groups


def near_copies():
    r = random.Random(21)
    words = [f"w{k}" for k in range(3000)]
    out = []
    for n in (1000, 1000, 400, 120, 60, 30):
        base = r.choices(words, k=n)
        out += [base, base + r.choices(words, k=3 * n // 20), base + r.choices(words, k=n // 2)]
        for every in (52, 50, 47, 33, 10):
            out.append([r.choice(words) if k % every == every // 2 else w for k, w in enumerate(base)])
    return [" ".join(x) for x in out]


def test_near_copies_of_five_words(spark):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.duplicate_stage(spark, docs, "").collect()}
    assert got == {min(g) for g in near_groups(texts)}
    assert 0 in got and not got & {1, 3, 4}


def test_null_and_repeated_ids(spark):
    texts = near_copies()[::8]
    copy = texts[0] + " end"
    rows = [(None, texts[0]), (None, copy), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (3, texts[3] + " end"), (9, texts[4]), (None, texts[4]), (None, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.duplicate_stage(spark, docs, "").collect())
    named = Counter({(None, texts[1]): 1, (7, texts[2]): 1, (3, texts[3] + " end"): 1, (9, texts[4]): 1, (None, None): 1, (5, ""): 1})
    assert got in (named + Counter([(None, texts[0])]), named + Counter([(None, copy)]))
