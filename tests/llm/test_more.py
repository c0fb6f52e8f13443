"""Planted links with measured recall, caches smaller than what they hold, rule sets of real size, the pipeline against plain Python, odd inputs."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from docquarry.llm import op1_suffix, op2_pieces, op3_secrets, op4_html, op5_mixing, op6_classifier, op7_quality, op8_vectors, op9_ngrams, op10_lines

WORDS = [a + b + c for a in ("ba", "ko", "mi", "tu", "re", "sol") for b in ("n", "r", "st") for c in ("a", "e", "io", "um")]


@pytest.mark.parametrize("dim", [8, 64])
def test_planted_vectors(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(3000, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    off = rng.normal(size=(300, dim))
    off -= (off * x[:300]).sum(axis=1)[:, None] * x[:300]
    off /= np.linalg.norm(off, axis=1)[:, None]
    near = 0.951 * x[:300] + np.sqrt(1 - 0.951**2) * off
    both = np.concatenate([x, near])
    want = both @ both.T >= 0.95
    got = {r["vid"]: r for r in op8_vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vid long, vector array<double>")).collect()}
    found = sum(got[i]["n_links"] for i in range(len(both)))
    assert all(got[i]["n_links"] <= want[i].sum() - 1 for i in range(len(both))) and found >= 0.99 * (want.sum() - len(both)) > 500
    assert sum(got[3000 + i]["component"] == got[i]["component"] for i in range(300)) >= 297


def test_pieces_with_a_small_cache(monkeypatch):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=op2_pieces.MODEL)
    for name, value in (("REMEMBERED", 20_000), ("WORDS", 300), ("INDEXED", 500)):
        monkeypatch.setattr(op2_pieces, name, value)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeé漢🙂-") for _ in range(rng.randint(1, 12))) for _ in range(200)) for _ in range(30)] + ["q" * 3000, "".join(rng.choice("abc") for _ in range(2500)), "x\0y", " a  b ", "\t\n"]
    with open(op2_pieces.MODEL, "rb") as f:
        e = op2_pieces.Encoder(op2_pieces.Model(f.read()))
    for _ in range(2):
        assert [i.tolist() for i in e.encode(texts)] == [sp.encode(t) for t in texts]
    assert e.held < 200_000


def test_many_rules(spark):
    rules = tuple(op3_secrets.Rule(f"k{i}", f"key{chr(97 + i % 26)}{chr(97 + i // 26)}xx[0-9]+", 0, 8) for i in range(60))
    rows = [(i, f"a {'KEY' if i % 2 else 'key'}{chr(97 + i % 26)}{chr(97 + i // 26)}xx{10**5 + i} b") for i in range(60)] + [(None, "keyaaxx123456"), (None, None), (7, ""), (7, "keyaax1")]
    got = op3_secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), base=rules[:1], more=rules[1:]).collect()
    assert len({g for r in rules for c in op3_secrets.trigram_query(r.regex) for g in c}) > 62
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["spans"])) for r in got) == sorted((i is None, i or 0, int(bool(t) and t.startswith(("a key", "keyaaxx1234")))) for i, t in rows)


def make(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    line = make(rng, 12)
    rows = [[i, f"{make(rng, 70)}\n{line}\n{make(rng, 30)}", rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), 7] for i in range(40)]
    rows += [[50 + i, rows[i][1].replace(WORDS[0], "other", 1), "en", "s1", 7] for i in range(5)]
    rows += [[60, None, "en", "s1", 0], [61, "", None, None, 0], [62, "short text", "de", "s2", 0], [3, rows[3][1], "en", "s1", 7], [None, make(rng, 90), "en", "s2", 7], [64, make(rng, 4000), "en", "s2", 7]]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, [tuple(r) for r in rows]


def test_pipeline(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    text = lambda t: t or ""
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        seen[name] = [r.asDict() for r in out.collect()]
        if name != "pieces":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(seen[name], out.schema)
    # quality: what the judged scores keep, and that only
    judged = op7_quality.judged(op7_quality.scored(spark.read.parquet(f"{path}/documents.parquet"), ["doc_id", "text", "lang"]), "lang").where("q_kept").collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"])
    assert sorted(map(key, seen["quality rules"])) == sorted(map(key, judged)) and len(judged) > 30 and all(r["doc_id"] not in (60, 61, 62) for r in judged)
    # lines: the shared line stays in the last document alone
    holders = {}
    for r in seen["quality rules"]:
        for x in r["text"].split("\n"):
            if len(x.strip(" \t\r").lower()) >= 40:
                holders.setdefault(x.strip(" \t\r").lower(), set()).add(-1 if r["doc_id"] is None else r["doc_id"])
    own = lambda r: -1 if r["doc_id"] is None else r["doc_id"]
    want = ["\n".join(x for x in r["text"].split("\n") if not (len(h := holders.get(x.strip(" \t\r").lower(), ())) >= 5 and max(h) != own(r))) for r in seen["quality rules"]]
    assert sorted(want) == sorted(r["text"] for r in seen["line dedup"])
    # near copies: one document of each class
    sets = [(own(r), r["text"], {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}) for r in seen["line dedup"] for w in [r["text"].lower().split()]]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i][0] == sets[j][0] or 100 * len(sets[i][2] & sets[j][2]) >= 80 * len(sets[i][2] | sets[j][2]):
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    least = {c: min(sets[i][0] for i in range(len(sets)) if label[i] == c) for c in set(label)}
    assert sorted(own(r) for r in seen["n-gram Jaccard join"]) == sorted(sets[i][0] for i in range(len(sets)) if sets[i][0] == least[label[i]])
    # mixing: copies of these documents, none more than twice, near their sources' targets
    before, after = (Counter(map(key, seen[name])) for name in ("n-gram Jaccard join", "mixing"))
    assert set(after) <= set(before) and all(after[k] <= 2 * before[k] for k in after)
    # pieces: ids that decode to the text
    model = op2_pieces.Model(open(op2_pieces.MODEL, "rb").read(), merges=False)
    assert sorted(op2_pieces.decode(model, r["ids"]) for r in seen["pieces"]) == sorted(text(r["text"]) for r in seen["mixing"])
    assert len(corpus_pipeline.run(spark, path).collect()) == len(seen["pieces"])


def test_mix_targets(spark):
    rng = random.Random(4)
    rows = [(i, make(rng, rng.randint(1, 60)), s) for i, s in enumerate(rng.choices(["a", "b", "c", "ä", None], [70, 15, 5, 5, 5], k=1500))]
    got = op5_mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else weight[s] * share
            left -= target[s] if full else 0
        open_ -= full or open_
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * target[r["source"]] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 120), (s, taken[s], target[s])


def test_odd_columns_and_empty_tables(spark):
    names = ["did", "node", "key", "rules", "slice", "n", "part", "id", "component", "size", "rep", "dig", "idx"]
    rows = [(i, make(random.Random(i), 60), "en", "s", *range(len(names))) for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names)
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    for table, n in ((docs, 12), (none, 0)):
        assert op1_suffix.removed(table, with_text=False).count() == n
        assert op2_pieces.encoded_and_decoded(table, ["doc_id", "text"]).where("decoded = text").count() == n
        assert op3_secrets.scan_secrets(table).count() == n
        assert op5_mixing.mix_sources(table).count() == n
        assert op6_classifier.classified(table, labels).count() == n
        kept = op7_quality.kept_documents(table)
        assert kept.columns == table.columns and kept.count() <= n
        first = op9_ngrams.first_documents(table)
        assert first.columns == table.columns and first.count() == n
        assert op10_lines.kept_lines(table).count() == n
    assert op8_vectors.near_vectors(spark.createDataFrame([], "vid long, vector array<double>")).count() == 0
    assert op4_html.extracted(spark.createDataFrame([(1, "u", None, 5)], "page_id long, url string, html string, tokens int")).collect()[0]["n_chars"] == 0
