"""Near duplicates, passages, nearest neighbours, languages, scores and the pipeline beside plain versions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tickloom.llm import ann, language_id, lm_score, near_dedup, packing, substring_dedup
from tickloom.llm.tokens import WordIds, WordTable, vocabulary


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def plain_groups(rows, k):
    sets = [(i, s) for i, t in rows if i is not None and (s := shingles(t, k))]
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    places = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            places[x].append(n)
    for n, (i, s) in enumerate(sets):
        for m, both in Counter(m for x in s for m in places[x] if m < n).items():
            if 100 * both >= 80 * (len(s) + len(sets[m][1]) - both):
                a, b = top(i), top(sets[m][0])
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in up}


def test_near_groups(docs, sample, empty):
    for table, k in ((docs, 2), (sample, 2), (sample, 5)):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        want, text = plain_groups(rows, k), dict(rows)
        got = near_dedup.near_groups(table, words=k).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(text[r.doc_id], k)), want[r.doc_id], r.doc_id == want[r.doc_id])
    assert near_dedup.near_groups(empty).count() == 0


def test_chains_and_blocks_of_near_texts(spark, monkeypatch):
    """A drifting chain and a star of variants; tiny blocks make every open bucket meet itself in parts."""
    monkeypatch.setattr(near_dedup, "BLOCK", 120)
    words = [f"w{i}" for i in range(60)]
    chain = [(i, " ".join(words[i:] + [f"x{j}" for j in range(i)])) for i in range(25)]
    star = [(100 + i, " ".join(f"v{j}" if j != i and j != (i * 7) % 40 else f"u{i}{j}" for j in range(40))) for i in range(40)]
    table = spark.createDataFrame(chain + star, "doc_id long, text string")
    want = plain_groups(chain + star, 2)
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(table, words=2).collect()} == want


def test_keep_one_near(docs, empty):
    out = near_dedup.keep_one(docs)
    kept = {r.doc_id for r in near_dedup.near_groups(docs).collect() if r.kept}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept and near_dedup.keep_one(empty).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(9, 9)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i
    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: top(i) for a, b in edges if a != b for i in (a, b)}


def is_run(parts):
    n = sum(map(len, parts))
    return (len(parts) >= 3 and n >= 20 or n >= 30) and len({w for p in parts for w in p}) >= 12


def plain_removed(rows):
    first, places = {}, defaultdict(list)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        parts = substring_dedup.sentences(t or "")
        w = [x.lower().split() for x in parts]
        k = [n for n, x in enumerate(w) if x]
        for a in range(len(k)):
            for b in range(a + 1, len(k) + 1):
                if is_run([w[x] for x in k[a:b]]):
                    run = tuple(tuple(w[x]) for x in k[a:b])
                    if run in first:
                        places[i].append((k[a], k[b - 1] + 1))
                    first.setdefault(run, (i, a))
                    break
    return {i: {n for a, b in r for n in range(a, b)} for i, r in places.items()}


def test_passages(sample, docs, empty, spark):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    want, text = plain_removed(rows), dict(rows)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(sample).collect()}
    assert set(got) == set(want)
    for i, gone in want.items():
        parts = substring_dedup.sentences(text[i])
        assert got[i].text == "".join(p for n, p in enumerate(parts) if n not in gone).rstrip() and got[i].repeats.n_removed == len(gone)
    assert {r.doc_id for r in substring_dedup.remove_repeats(docs).collect()} >= {1, 2, 3} and substring_dedup.remove_repeats(empty).count() == 0
    passage = " ".join(f"p{i}" for i in range(30)) + ". " + " ".join(f"q{i}" for i in range(25)) + "."
    two = spark.createDataFrame([(1, "Own start here. " + passage + " Own end."), (2, "Other.\n" + passage), (3, "Clean text only.")], "doc_id long, text string")
    assert [(r.doc_id, r.text, r.repeats.first_docs) for r in substring_dedup.remove_repeats(two, ends=True).collect()] == [(2, "Other.", [1])]


def plain_nearest(table, every=20, k=20):
    ok = [r for r in table if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, x = np.array([r.vec_id for r in ok]), np.array([r.embedding for r in ok], float)
    out = {}
    for n in np.flatnonzero(ids % every == 0):
        s = (x * x[n]).sum(axis=1)
        best = [m for m in np.lexsort((ids, -s)) if ids[m] != ids[n]][:k]
        out[ids[n]] = [(int(ids[m]), s[m]) for m in best]
    return out


def test_nearest(spark, sf):
    for path in (sf, "/root/testdata/sf0.1"):
        table = spark.read.parquet(f"{path}/embeddings.parquet")
        want = plain_nearest(table.collect())
        got = defaultdict(list)
        for r in ann.search(table).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert set(got) == set(want)
        assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
        for q, hits in got.items():
            assert len(hits) == len(want[q]) and hits == sorted(hits, key=lambda h: (-h[1], h[0]))


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(table, k=2).orderBy("query_id", "rank").collect()] == [
        (0, 1, 1, 2.0), (0, 2, 2, 2.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0)]
    assert ann.search(table.filter("vec_id = 3")).count() == 0 and ann.search(table.limit(0)).count() == 0


def test_languages(sample, docs, empty, spark, sf):
    """Held-out accuracy: fitted on half of the rows, without their declared language, on the other half."""
    model = language_id.fit(sample.filter("doc_id % 2 = 0"))
    held = sample.filter("doc_id % 2 = 1").select(F.col("doc_id").cast("string").alias("id"), "text", F.lit(None).cast("string").alias("declared"),
                                                  F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("site"))
    got = {int(r.id): r for r in language_id.identify(held, model).collect()}
    true = {r.doc_id: r.lang for r in sample.collect()}
    assert np.mean([got[i].lang == true[i] for i in got]) > 0.95
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 2, 3, 7, 8, 10, 11, 12} <= set(ids) and not {4, 5, 6} & set(ids) and ids.count(11) == 2 and None in ids
    assert language_id.keep_identified(empty, model).count() == 0 and language_id.keep_identified(empty).count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert language_id.identify(language_id.page_rows(pages), model).filter("accepted").count() > 0.95 * pages.count()


def test_priors_decide_where_text_is_thin(sample, spark):
    model = language_id.fit(sample)
    de = [r.text for r in sample.filter("lang = 'de'").limit(20).collect()]
    rows = [(str(n), t, "de", "de", "a.de", "a.de") for n, t in enumerate(de)] + [("x", "x", "de", "de", "a.de", "a.de"), ("y", "", "de", "de", "a.de", "a.de")]
    got = {r.id: r for r in language_id.identify(spark.createDataFrame(rows, "id string, text string, declared string, suffix string, host string, site string"), model).collect()}
    assert got["x"].lang == "de" and got["y"].lang == "und" and not got["y"].accepted


def test_scores(sample, empty, docs):
    path = vocabulary("word_bpe_49k.json")
    for table in (sample, docs):
        rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in table.collect()]
        out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        c = Counter(w for i, ws in rows if not out(i) for w in [*ws, None])
        n, v = sum(c.values()), len(c)
        want = sorted((-1 if i is None else i, out(i), len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n,
                       round(float(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None])), 4)) for i, ws in rows)
        got = lm_score.score(table, path).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)
        ids = WordIds(path)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_ids) for r in got) == sorted(
            (-1 if i is None else i, 1 + sum(len(ids.cache[w]) // 4 for w in ws)) for i, ws in rows)
    assert lm_score.score(empty, path).count() == 0


def test_unseen_texts_are_likelier_by_the_model(spark, sf):
    path = vocabulary("word_bpe_49k.json")

    def means(size, **p):
        docs = spark.read.parquet(sf.replace("0.001", size) + "/documents.parquet")
        return lm_score.score(docs, path, **p).filter("held_out").agg(F.avg("score"), F.avg("base_score")).first()
    assert means("0.01", share=4)[0] > means("0.01", rounds=0)[0]  # than without attention that has learnt
    got = means("0.1")
    assert got[0] > got[1]  # and than by counts of words, from some thousand texts on


def plain_log10(model, ids):
    """One id at a time: attention over what its window holds of the ids before it."""
    w, out, before = model.weights, [], [len(model.entry) - 1, *ids[:-1]]
    for at, target in enumerate(ids):
        first = max(0, at - at % lm_score.STEP - lm_score.BEHIND)
        e = w["E"][model.entry[before[first:at + 1]]]
        s = (e[-1] @ w["Q"]) @ (e @ w["K"]).T + w["R"][np.arange(at - first, -1, -1)]
        s = np.exp(s - s.max())
        logits = model.bigram[model.entry[before[at]]] + (e[-1] + s @ (e @ w["V"]) / s.sum()) @ w["O"]
        share = model.share[model.mark[before[at]]]
        assert np.isclose(np.exp(share[model.kind == model.kind[target]]).sum(), 1, atol=1e-4)
        out.append((logits[model.kind[target]] - np.log(np.exp(logits).sum()) + share[target]) / np.log(10))
    return np.array(out)


def test_attention_is_causal_sums_to_one_and_learns():
    rng = np.random.default_rng(0)
    lengths = np.array([150, 1, 17, 250, 16])
    ids = np.cumsum(rng.integers(1, 3, lengths.sum())) % 150  # what follows depends on what was before
    counts = np.bincount(ids, minlength=200).astype(float)
    ranked = np.bincount(lm_score.following(ids, lengths, lm_score.marks(counts)), minlength=200 * (lm_score.SINGLE + 1)).reshape(-1, 200)
    model = lm_score.Model.start(counts, lm_score.groups(ranked[:lm_score.SINGLE].T.astype(float)))
    classes = model.bigram.shape[1]
    model.follow(np.bincount(model.inputs(ids, lengths) * classes + model.kind[ids], minlength=model.bigram.size).reshape(-1, classes).astype(float),
                 np.bincount(lm_score.following(ids, lengths, model.mark), minlength=model.share.size).reshape(-1, 200).astype(float))
    before = model.log10(ids, lengths).sum()
    trainer = lm_score.Trainer(model)
    for _ in range(30):
        trainer.learn(ids, lengths, 1, 0)
    got = model.log10(ids, lengths)
    assert got.sum() > before
    ends = np.cumsum(lengths)
    assert np.allclose(got, np.concatenate([plain_log10(model, ids[e - n:e]) for e, n in zip(ends, lengths, strict=True)]), atol=1e-4)
    changed = ids.copy()
    changed[60] = (ids[60] + 1) % 200
    other = model.log10(changed, lengths)
    assert np.allclose(got[:60], other[:60], atol=1e-5) and np.allclose(got[150:], other[150:], atol=1e-5) and not np.allclose(got[61:70], other[61:70], atol=1e-5)
    assert abs(sum(10 ** model.log10(np.append(ids[:40], x), np.array([41]))[-1] for x in range(200)) - 1) < 1e-3
    every = np.sort(np.concatenate([lm_score.windows(lengths, 3, f)[0][:, lm_score.BEHIND:][lm_score.windows(lengths, 3, f)[2]] for f in range(3)]))
    assert (every == np.arange(lengths.sum())).all()


def test_every_window_is_learnt_from():
    """The rounds of a fit take each window of every training text once, none twice."""
    assert lm_score.SHARE == lm_score.ROUNDS
    lengths = np.array([40, 1, 333, 16, 5])
    rounds = [lm_score.windows(lengths, lm_score.SHARE, number) for number in range(lm_score.ROUNDS)]
    seen = np.sort(np.concatenate([place[:, lm_score.BEHIND:][scored] for place, _, scored in rounds]))
    assert (seen == np.arange(lengths.sum())).all()


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    lengths, ids = np.array([40, 9]), rng.integers(0, 120, 49)
    model = lm_score.Model.start(np.bincount(ids, minlength=120).astype(float), np.arange(120) % lm_score.GROUPS)
    model.weights = {n: a.astype(np.float64) + (rng.standard_normal(a.shape) * 0.1 if n in "RO" else 0) for n, a in model.weights.items()}
    loss = lambda: -(model.log10(ids, lengths) * np.log(10) - model.share[0][ids]).mean()
    start, moved = {n: a.copy() for n, a in model.weights.items()}, lm_score.Trainer(model)
    moved.learn(ids, lengths, 1, 0)  # one step: the first moment is a tenth of the gradient
    for n, a in start.items():
        model.weights = {m: b.copy() for m, b in start.items()}
        i = np.unravel_index(np.abs(moved.m[n]).argmax(), a.shape)
        model.weights[n][i] = a[i] + 1e-3
        up = loss()
        model.weights[n][i] = a[i] - 1e-3
        assert np.isclose((up - loss()) / 2e-3, moved.m[n][i] * 10, rtol=0.05, atol=1e-4), n


def test_scores_too_large_for_exp():
    """Large weights, in some windows only, give what one id at a time gives."""
    rng = np.random.default_rng(5)
    lengths, ids = np.array([70, 9]), rng.integers(0, 120, 79)
    model = lm_score.Model.start(np.bincount(ids, minlength=120).astype(float), np.arange(120) % lm_score.GROUPS)
    start = model.weights
    for scale in (1, 4):
        model.weights = {n: a.astype(np.float64) * (scale if n == "E" else 1) + (scale * rng.standard_normal(a.shape) if n in "KO" else 0) for n, a in start.items()}
        got = model.log10(ids, lengths)
        want = np.concatenate([plain_log10(model, ids[e - n:e]) for e, n in zip(np.cumsum(lengths), lengths, strict=True)])
        assert np.isfinite(got).all() and np.allclose(got, want, atol=1e-3, rtol=1e-4)
        trainer = lm_score.Trainer(lm_score.replace(model, weights={n: a.copy() for n, a in model.weights.items()}))
        trainer.learn(ids, lengths, 1, 0)
        assert all(np.isfinite(a).all() for a in trainer.model.weights.values())


def test_words_are_pieced_without_the_whole_tokenizer():
    """Accented letters and the marks behind a word are pieces, which are encoded once, and as the library does."""
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    ids, tok = WordIds(path), Tokenizer.from_file(path)
    words = ["caf\u00e9***", "\u00e9t\u00e9,", "stra\u00dfe", "it's", "l'\u00e9t\u00e9.", "a,b", "x'", "\u00f7a", "\u00c9a", "e\u0301!", "don't,!!", "a<|", "ab1,", "z_z", "(q)"]
    for w in words:
        assert np.frombuffer(ids.cache[w.encode()], "<u4").tolist() == tok.encode(w, add_special_tokens=False).ids, w
    assert {b"***", "caf\u00e9".encode()} <= set(ids.cache) | set(ids.cache.old)


def test_words_known_by_their_hashes_are_not_encoded_again():
    """Columns are encoded as word by word, also when a table lets words go; a known word is never looked up by its letters."""
    tokens = WordIds(vocabulary("word_bpe_49k.json"))
    columns = [pa.array(t) for t in (["One fish", "", " \t", "two fish, (Red) fish ", "\u00c9t\u00e9 e\u0301"], [""], ["two\x0bone", "z" * 5000 + " q " + " ".join("y" * n for n in range(1, 80))], ["fish q", "ONE two"])]
    for limit in (1 << 20, 6):
        table = WordTable(tokens, limit)
        for n, column in enumerate(columns):
            if n == 3 and limit > 6:
                table.tokens = None  # all words of the last column were in earlier ones
            h, counts, first, end = lm_score._hashes(pa.RecordBatch.from_arrays([column], ["text"]), 0)
            assert len(set(h.tolist())) == len({w for t in column.to_pylist() for w in t.encode().lower().split()})
            distinct, place, inverse = lm_score.distinct_words(h)
            assert (distinct[inverse] == h).all() and (h[place] == distinct).all() and (distinct[1:] > distinct[:-1]).all()
            ids, lengths = lm_score.encode_texts(column, table, counts, first, end, distinct, place, inverse)
            want = [[*np.frombuffer(b"".join(tokens.cache[w.lower()] for w in t.encode().split()), "<u4").tolist(), tokens.size - 1] for t in column.to_pylist()]
            assert ids.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))
            assert len(table.h) <= limit


def test_each_text_is_cut_once_for_its_runs(spark, monkeypatch):
    """A pass for the hashes and one for the places share one cutting; runs of many texts are those of each."""
    rng = np.random.default_rng(6)
    texts = ["".join(f"{chr(97 + int(n))}{int(m)}{'.' if m % 3 else ''} " for n, m in rng.integers(0, 26, (int(k), 2))) for k in rng.integers(0, 90, 40)]
    texts += ["", " \n ", "one two " * 40 + "three four five six seven eight nine ten eleven twelve. " * 2, texts[5] + texts[9], texts[9] + texts[5]]
    parts = [substring_dedup.sentences(t) for t in texts]
    for ends in (True, False):
        text, *found = substring_dedup.runs_of(parts, ends)
        assert [(n, *r) for n, p in enumerate(parts) for r in substring_dedup.runs(p, ends)] == list(zip(text.tolist(), *(x.tolist() for x in found), strict=True))
    plans, pin = [], substring_dedup.pin
    monkeypatch.setattr(substring_dedup, "pin", lambda df: plans.append(df._jdf.queryExecution().toString()) or pin(df))
    substring_dedup.repeated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert sum("MapInArrow" in p for p in plans) == 1


def test_pipeline(spark, sample, sf):
    docs, seen = sample, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == sample.columns
        seen[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    texts = {r.doc_id: r.text for r in sample.collect()}
    assert len(seen["language"]) >= 0.99 * len(texts)
    best = {}
    for i, t in seen["language"].items():
        best[t] = max(best.get(t, -1), i)
    assert set(seen["exact"]) == set(best.values())
    roots = plain_groups(list(seen["exact"].items()), 5)
    assert set(seen["near"]) == {i for i, r in roots.items() if i == r}
    assert set(seen["secrets"]) == set(seen["near"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(seen["secrets"]) and max(r.sequence_length for r in packed) <= packing.TIERS[-1]


def test_registry():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


def every_run_removed(docs):
    """Sentences by document (in the order of ``docs``) that a non-first place of any run covers, whatever its length."""
    first, gone = {}, [set() for _ in docs]
    for d, t in enumerate(docs):
        w = [x.lower().split() for x in substring_dedup.sentences(t)]
        k = [n for n, x in enumerate(w) if x]
        for a in range(len(k)):
            for b in range(a + 1, len(k) + 1):
                if is_run([w[x] for x in k[a:b]]):
                    run = tuple(tuple(w[x]) for x in k[a:b])
                    if first.setdefault(run, (d, a)) != (d, a):
                        gone[d] |= set(range(k[a], k[b - 1] + 1))
    return gone


def sentence(name, n):
    return " ".join(f"{name}{i}" for i in range(n)) + ". "


def test_ends_of_passages(spark):
    """The last sentences of a repeated passage go too, however short they are."""
    tables = [[sentence(f"s{d}", 4) + "".join(sentence(n, k) for n, k in passage) + sentence(f"e{d}", 30) for d in range(2)]
              for passage in ([("a", 30), ("b", 30), ("c", 8)], [("a", 20), ("b", 4), ("c", 4), ("d", 4)])]
    rng = np.random.default_rng(4)
    pool = [sentence(f"p{i}", int(n)) for i, n in enumerate(rng.integers(1, 30, 12))]
    for _ in range(12):
        tables.append(["".join("".join(pool[at:at + n]) if n > 1 else sentence(f"x{at}{d}", 5) for at, n in rng.integers((0, 1), (10, 9), (4, 2))) for d in range(3)])
    rows, want = [], {}
    for n, texts in enumerate(tables):
        texts = [" ".join(f"t{n}{w}" for w in t.split()) for t in texts]  # tables share no words
        rows += [(100 * n + d, t) for d, t in enumerate(texts)]
        want |= {100 * n + d: g for d, g in enumerate(every_run_removed(texts)) if g}
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ends=True).collect()}
    assert {i: r.repeats.n_removed for i, r in got.items()} == {i: len(g) for i, g in want.items()}
    for i, g in want.items():
        assert got[i].text == "".join(s for n, s in enumerate(substring_dedup.sentences(dict(rows)[i])) if n not in g).rstrip()
    assert want[1] == {1, 2, 3} and want[101] == {1, 2, 3, 4}


def test_runs_are_cut_at_clauses_and_need_different_words(spark):
    """A passage glued to other text at both ends goes but for its outer clauses' remains; repeated shouting stays; long dull stretches are linear."""
    inner = ", ".join(" ".join(f"w{i}{j}" for j in range(9)) for i in range(6))
    rows = [(d, f"Text {d} begins and then, {inner}, and ends otherwise {d} here.") for d in (1, 2)] + [(3, "THE!! AND!! OF!! " * 40), (4, "THE!! AND!! OF!! " * 40)]
    got = {r.doc_id: r for r in substring_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].text == "Text 2 begins and then, and ends otherwise 2 here." and got[1].text == rows[0][1]
    assert got[3].repeats.n_removed == got[4].repeats.n_removed == 0
    dull = ["no. "] * 200_000 + [f"{w}. " for w in "abcdefghijklmn"]
    assert len(substring_dedup.runs(dull)) > 199_000


def test_passages_of_rows_with_one_id(spark):
    """Rows with a null or repeated id are documents of their own; of equal rows all but one are emptied."""
    shared, clean = sentence("a", 30) + sentence("b", 30), sentence("c", 30) + sentence("d", 30) + "End."
    rows = [(None, sentence("x", 3) + shared), (None, shared + "Own."), (None, clean), (7, "Seven. " + sentence("e", 60)), (7, sentence("e", 60) + "Other."),
            (7, sentence("f", 60) + "Kept."), (8, "Eight " + sentence("g", 60)), (8, "Eight " + sentence("g", 60)), (8, "Eight " + sentence("g", 60))]
    got = Counter((r.doc_id, r.text, r.repeats.n_removed, tuple(r.repeats.first_docs)) for r in substring_dedup.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ends=True).collect())
    one = [Counter({(None, t, 2, ()): 1, (7, u, 1, (7,)): 1, (8, "", 1, (8,)): 2}) for t in (sentence("x", 3).rstrip(), "Own.") for u in ("Seven.", "Other.")]
    assert got in one


def test_passages_give_every_document(spark, docs, empty, sf):
    assert substring_dedup.clean(empty).count() == 0
    for table in (docs, docs.filter("doc_id != 11")):
        rows = substring_dedup.clean(table).collect()
        assert Counter((r.doc_id, r.lang) for r in rows) == Counter((r.doc_id, r.lang) for r in table.collect())
        before = {r.doc_id: r.text or "" for r in table.collect()}
        for r in rows:
            parts = substring_dedup.sentences(before[r.doc_id])
            assert r.repeats.n_sentences == len(parts) and (r.repeats.n_removed or (r.text, r.repeats.first_docs) == (before[r.doc_id], []))
        assert {r.doc_id for r in rows if r.repeats.n_removed} >= {1, 2, 3}
    assert entry.queries()["op4_substring_dedup"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_slots_of_a_large_open_bucket_are_bounded(spark, monkeypatch):
    """One component of many members meets a single stranger: no copies inside it, and no slot far beyond its size."""
    monkeypatch.setattr(near_dedup, "BLOCK", 400)
    monkeypatch.setattr(near_dedup, "GROUP", 20)
    reps = spark.range(600).select(F.col("id").alias("doc_id"), F.lit(b"s").alias("sig"), F.array(F.lit(1).cast("long")).alias("bands"))
    members = lambda roots: spark.createDataFrame([(5, i, 40, r) for i, r in enumerate(roots)], "bucket long, id long, n long, root long")
    rows = near_dedup._dealt(members([0] * 599 + [599]), reps).select("i", "j", "own", "id", "root", "slot").collect()
    assert len(rows) == 599 + 1 + 60 and max(Counter(r.slot for r in rows).values()) <= 120
    roots = [0] * 60 + list(range(60, 100))
    rows = near_dedup._dealt(members(roots), reps).select("i", "j", "own", "id", "slot").collect()
    assert max(Counter(r.slot for r in rows).values()) <= 120
    groups, met = defaultdict(list), Counter()
    for r in rows:
        groups[r.i, r.j].append(r)
    for (i, j), part in groups.items():
        left, right = ([r.id for r in part if r.own == b] for b in (i, j))
        met.update(tuple(sorted((a, b))) for a in left for b in right if i != j or a < b)
    assert all(met[a, b] == (1 if roots[a] != roots[b] else 0) for a in range(100) for b in range(a + 1, 100))


def test_pipeline_writes_token_ids(spark, docs, sf):
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)


def test_rare_languages_are_learnt(spark):
    """Of 20,003 labelled rows 3 are in a language of their own; all three are examples, and a null label is none."""
    common = spark.range(20_000).select("id", F.lit("the house and the garden are behind the hill").alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(-i, "zzyx qoph wuzz zzyx qoph", "zz") for i in range(1, 4)] + [(-9, "abc", None), (-10, None, "yy")], "id long, text string, lang string")
    model = language_id.fit(common.unionByName(rare), key="id", labelled=200)
    assert model.languages == ["en", "zz"]
    rows = spark.createDataFrame([("a", "zzyx wuzz qoph"), ("b", "the garden")], "id string, text string").select("*", *[F.lit(None).cast("string").alias(c) for c in ("declared", "suffix", "host", "site")])
    assert {r.id: r.text_lang for r in language_id.identify(rows, model).collect()} == {"a": "zz", "b": "en"}
