"""The corpus operators against SQL, brute force and round trips, on awkward rows and on an empty table."""

import hashlib
import math
from collections import Counter

import brute
import duckdb
import pytest
from compare import differences
from pyspark.sql import functions as F

from kinespark.llm import catalog, exact_dedup, jaccard_join, mixing, pieces, quality_model, quality_rules
from kinespark.llm import planted_findings, secret_scan, suffix_dedup, token_counts, warc
from kinespark.llm.graph import components
from kinespark.session import stage


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_awkward_rows_equal_sql(spark, awkward_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{awkward_dir}/{table}.parquet/*.parquet')")
    assert differences(catalog.QUERIES[name](spark, awkward_dir), con, catalog.SQL[name]) == []


@pytest.mark.parametrize("run", [
    quality_rules.judge, mixing.mix, mixing.emit, exact_dedup.label, exact_dedup.keep_first, jaccard_join.cluster,
    jaccard_join.keep_one, suffix_dedup.repeated_spans, token_counts.count_tokens, pieces.encode,
], ids=lambda f: f"{f.__module__.split('.')[-1]}.{f.__name__}")
def test_empty_table(nothing, run):
    assert run(nothing).count() == 0


def test_empty_tables_with_labels(spark, nothing, labels):
    assert quality_model.classify(nothing, labels.limit(0)).count() == 0
    assert secret_scan.scan(nothing, labels.limit(0)).count() == 0
    captures = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    blocks, directory = warc.build_index(captures)
    assert warc.read_ranges(warc.find(captures.select("key", "page_id"), blocks, directory)).count() == 0


def test_rule_order_follows_worth_and_not_the_verdict(spark, awkward):
    measured = quality_rules.measure(awkward[1])
    rules = quality_rules.default_rules()
    ordered = quality_rules.order_rules(measured, rules)
    assert {r.name for r in ordered} == {r.name for r in rules}
    backward = quality_rules.cascade(measured, ordered[::-1])
    assert plain(quality_rules.cascade(measured, ordered).filter("rejected_by IS NULL"), "doc_id") == plain(
        backward.filter("rejected_by IS NULL"), "doc_id")


def test_mixture_takes_what_it_says(awkward):
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix(awkward[1]).collect()}
    emitted = Counter(r["doc_id"] for r in mixing.emit(awkward[1]).collect())
    rows = Counter(r[0] for r in awkward[0])
    assert emitted == Counter({d: mixed[d] * rows[d] for d in rows if mixed[d]})


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = [("a", 1), ("b", 1000), ("c", 10), (None, 500), ("d", 0)]
    found = mixing.with_targets(mixing.with_weights(spark.createDataFrame(sizes, "source string, source_size long")))
    targets = {r["source"]: r["target"] for r in found.collect()}
    share = {s: 0.0 for s, _ in sizes}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    left, active = 1.5 * sum(n for _, n in sizes), set(share)
    while True:
        level = left / sum(weights[s] for s in active)
        full = {s for s in active if level * weights[s] > 2 * dict(sizes)[s]}
        if not full:
            break
        for s in full:
            share[s] = 2.0 * dict(sizes)[s]
            left -= share[s]
        active -= full
    share |= {s: level * weights[s] for s in active}
    assert targets == pytest.approx(share)


def test_cuckoo_index_inserts_finds_deletes_and_grows():
    index, keys = exact_dedup.CuckooIndex(2), [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for k, key in enumerate(keys):
        index.insert(key, (k, 1))
    assert index.count == 3000 and index.mask > 500 and all(index.find(key) == (k, 1) for k, key in enumerate(keys))
    assert all(index.delete(key) for key in keys[::2]) and not index.delete(keys[0])
    assert [index.find(key) is not None for key in keys] == [k % 2 == 1 for k in range(3000)]
    assert all(index.maybe(key) for key in keys[1::2])


def test_index_over_batches(spark):
    def rows(*texts):
        return exact_dedup.pre_aggregate(exact_dedup.digests(spark.createDataFrame(texts, "doc_id long, text string")))

    index = exact_dedup.build(rows((1, "a"), (2, "A"), (3, "b"), (4, None)))
    index = exact_dedup.build(rows((5, "a"), (6, "c"), (7, "")), index)
    assert plain(index, "keep_id", "group_size") == [(3, 1), (5, 3), (6, 1), (7, 2)]
    index = exact_dedup.remove(index, exact_dedup.digests(spark.createDataFrame([(0, "B"), (0, "x")], "doc_id long, text string")))
    assert plain(index, "keep_id", "group_size") == [(5, 3), (6, 1), (7, 2)]


def test_jaccard_components_equal_all_pairs(spark, awkward):
    unique = list({r[0]: r for r in awkward[0]}.values())
    expected = brute.components([r[:2] for r in unique])
    got = jaccard_join.cluster(awkward[1].dropDuplicates(["doc_id"]))
    assert plain(got, "doc_id", "n_shingles", "component_id") == sorted(expected, key=repr)


@pytest.mark.parametrize("spread", [3, 9, 14])
def test_jaccard_of_near_copies_at_the_threshold(spark, spread):
    import random

    rng = random.Random(spread)
    base = [f"w{k}" for k in range(220)]
    rows = []
    for k in range(60):
        words = list(base[: rng.choice([40, 220])])
        for _ in range(rng.randrange(spread)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, f"only {k}") for k in range(3)] + [(200, "solo"), (201, "Solo")]
    got = jaccard_join.cluster(spark.createDataFrame(rows, "doc_id long, text string"))
    assert plain(got, "doc_id", "n_shingles", "component_id") == sorted(brute.components(rows), key=repr)


def test_pairs_are_found_with_every_boundary(spark, monkeypatch):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 5, 60 + 3 * (k % 4)))) for k in range(40)]
    expected = sorted(brute.components(rows), key=repr)
    for heavy in (1, 55, 10_000):
        monkeypatch.setattr(jaccard_join, "boundary", lambda *_: heavy)
        for waves in (0, 4):
            monkeypatch.setattr(jaccard_join, "WAVES", waves)
            got = jaccard_join.cluster(spark.createDataFrame(rows, "doc_id long, text string"))
            assert plain(got, "doc_id", "n_shingles", "component_id") == expected


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_of_small_sets_at_the_threshold(spark, percent):
    rows, size, words = [], {}, 4
    for n in range(1, 41):
        for m in range(1, n + 1):
            overlap = next((o for o in range(1, m + 1) if 100 * o >= percent * (n + m - o)), None)
            if overlap:
                a = len(rows)
                text = [f"p{a}w{k}" for k in range(n + m - overlap + words - 1)]
                rows += [(a, " ".join(text[: n + words - 1])), (a + 1, " ".join(text[n - overlap :]))]
                size |= {a: n, a + 1: m}
    assert (7, 6) in {(size[a], size[a + 1]) for a in range(0, len(rows), 2)}
    got = jaccard_join.cluster(spark.createDataFrame(rows, "doc_id long, text string"), words, percent)
    assert plain(got, "doc_id", "n_shingles", "component_id") == sorted(((d, size[d], d - d % 2) for d, _ in rows), key=repr)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(20, 60)] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    found = dict(plain(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert found == {k: 20 for k in range(20, 61)} | {k: 100 for k in range(100, 130)}


def test_repeated_strings_equal_brute_force(awkward):
    short = [r for r in awkward[0] if r[1] is None or len(r[1]) < 5000]
    ids = {r[0] for r in short}
    got = suffix_dedup.repeated_spans(awkward[1].filter(awkward[1].doc_id.isin(*ids)))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert plain(got, *columns) == brute.repeated_strings([r[:2] for r in short])


def test_repeats_at_the_threshold(spark):
    import random

    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows, k = [], 0
    for size in (198, 199, 200, 201, 263, 264, 330):
        shared = noise(size)
        for _ in range(rng.choice([2, 3])):
            rows.append((k, noise(rng.randrange(150)) + shared + noise(rng.randrange(150))))
            k += 1
    rows.append((k, noise(90) + (period := noise(70)) * 5 + noise(20)))
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert plain(got, *columns) == brute.repeated_strings(rows) and period


def test_token_counts_equal_the_encoder_whatever_the_blocks(awkward):
    import tiktoken

    encoder = tiktoken.Encoding("t", pat_str=token_counts.PATTERN,
                                mergeable_ranks=token_counts.load_ranks(token_counts.RANKS), special_tokens={})
    expected = sorted((r[0], len(encoder.encode_ordinary(r[1] or ""))) for r in awkward[0])
    for block in (2, 64, 4096, 2**22):
        some = awkward[1] if block > 64 else awkward[1].filter("doc_id < 8")
        want = sorted((x for x in expected if block > 64 or x[0] < 8), key=repr)
        assert plain(token_counts.count_tokens(some, block_bytes=block), "doc_id", "n_tokens") == want


def test_pieces_equal_the_library_and_come_back(awkward):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r["doc_id"]: r for r in pieces.encode(awkward[1], share=1.0).collect()}
    for doc, text, *_ in awkward[0]:
        assert got[doc]["ids"] == library.encode(text or "") and got[doc]["round_trip"] and got[doc]["text"] == text
        assert pieces.Codec().decode(got[doc]["ids"]) == (text or "")


def test_captures_are_found_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = [(k, f"https://{'ab'[k % 2]}.Site{k % 7}.org/p?{k // 9}", None if k % 5 == 0 else f"<p>{k % 6}</p>" * 20) for k in range(80)]
    captures = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"))
    blocks, directory = warc.build_index(captures)
    assert len(directory) == blocks.count() > 10
    read = warc.read_ranges(warc.find(captures.select("key", "page_id"), blocks, directory)).collect()
    assert sorted(r["page_id"] for r in read) == list(range(80))
    html = {k: h or "" for k, _, h in pages}
    for r in read:
        if r["record_type"] == "response":
            assert bytes(r["payload"]).decode() == html[r["page_id"]]
        else:
            assert html[r["refers_to"]] == html[r["page_id"]] and r["refers_to"] < r["page_id"]
    wanted = spark.createDataFrame([("org,site1,b)/p?0", 1), ("org,none)/", 1)], "key string, page_id long")
    assert [r["page_id"] for r in warc.find(wanted, blocks, directory).collect()] == [1]


def test_repeated_conflicting_and_null_pages_equal_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    same, other, big = "<p>same</p>" * 20, "<p>other</p>" * 20, 2**53 + 1
    # page 1 is the response; 5 has revisits and a payload of its own, 7 is repeated, big has more digits than a float
    pages = [(1, "http://a.b/1", same), (5, "http://a.b/5", same), (5, "http://a.b/5", other), (5, None, None), (-3, "http://a.b/1", "x")]
    pages += [(7, "http://a.b/7", same)] * 9 + [(big, "http://a.b/7", other), (big + 1, "http://a.b/7", same)]
    pages += [(None, "http://a.b/7", same), (None, "http://a.b/7", same), (None, None, other), (None, "http://a.b/1", None)]
    pages += [(8, "http://a.b/8", other * 2), (8, "http://a.b/8", other * 2)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = stage(catalog.QUERIES["op7_warc"](spark, str(tmp_path)))
    assert got.count() == len(pages) and differences(got, con, catalog.SQL["op7_warc"]) == []


def test_url_keys(spark):
    urls = ["HTTP://User@Www.Example.COM:8080/A/b?c=D#e", "example.org", "http://x.y?q", None, ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(F.col("url")).alias("k"))
    assert [r[0] for r in df.collect()] == ["com,example,www)/A/b?c=D", "org,example)/", "y,x)/?q", ")/", ")/"]


def test_language_model_is_a_distribution_and_equals_plain_counts(spark, awkward):
    counted = quality_model.count_grams(awkward[1].filter("doc_id < 12"))
    model = quality_model.fit(counted)
    context = counted.orderBy("gram").first()["gram"] >> 8
    asked = spark.createDataFrame([((context << 8) | b,) for b in range(256)], "gram long")
    assert sum(r["p"] for r in quality_model.probabilities(asked, model).collect()) == pytest.approx(1.0)


def test_perplexities_are_sums_over_whole_texts(spark, awkward):
    model = quality_model.fit(quality_model.count_grams(awkward[1].filter("doc_id IN (7, 11, 19)")))
    got = {r["doc_id"]: r["perplexity"] for r in quality_model.perplexities(awkward[1], model).collect()}
    for doc in (3, 16, 21):
        keys, _ = quality_model.grams([awkward[0][doc][1].encode()])
        asked = spark.createDataFrame([(int(k),) for k in set(keys.tolist())], "gram long")
        p = {r["gram"]: r["p"] for r in quality_model.probabilities(asked, model).collect()}
        logs = [math.log(p[int(k)]) for k in keys]
        assert got[doc] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)
    assert got[0] is None and got[1] is None


def test_classifier_on_labelled_documents(spark, sf_dir):
    got = catalog.QUERIES["op1_quality_classifier"](spark, sf_dir.replace("0.001", "0.01"))
    truth = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet")
    kept = {(r["quality"], r["kept"]): r["count"] for r in got.join(truth, "doc_id").groupBy("quality", "kept").count().collect()}
    assert kept[(1, True)] > 0.97 * (kept[(1, True)] + kept.get((1, False), 0))
    assert kept[(0, False)] > 0.8 * (kept[(0, False)] + kept.get((0, True), 0))


def test_classifier_defines_awkward_rows(awkward, labels):
    got = quality_model.classify(awkward[1], labels)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert len(by_id) == len({r[0] for r in awkward[0]}) and not by_id[0]["kept"] and not by_id[1]["kept"] and by_id[7]["kept"]


@pytest.fixture(scope="module")
def forest(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.1") + "/documents.parquet")
    describer = secret_scan.fit_tables(docs)
    return docs, describer, secret_scan.train(spark, describer)


def test_forest_on_held_out_planted_findings_beats_the_rule(spark, forest):
    _, describer, fitted = forest
    scored = secret_scan.score(secret_scan.labelled(spark, describer, 3000, seed=99), fitted)
    right = {(r["label"], r["is_secret"]): r["count"] for r in scored.groupBy("label", "is_secret").count().collect()}
    assert right[(1, True)] > 0.95 * 1500 and right[(0, False)] > 0.95 * 1500
    by_rule = [
        (label, secret_scan.label_finding(text[at : at + size], text[max(0, at - 40) : at]))
        for text, at, size, label in planted_findings.planted(describer.words, 1500, 99)
    ]
    assert sum(label == verdict for label, verdict in by_rule) < 0.9 * len(by_rule)


def test_forest_on_findings_of_documents(forest):
    docs, describer, fitted = forest
    scored = secret_scan.score(secret_scan.findings(docs, describer), fitted)
    right = {(r["label"], r["is_secret"]): r["count"] for r in scored.filter("label IS NOT NULL").groupBy("label", "is_secret").count().collect()}
    # where the rule of thumb says something it is right about these documents' keys, mails and addresses
    assert right[(1, True)] > 0.95 * (right[(1, True)] + right.get((1, False), 0))
    assert right[(0, False)] > 0.97 * (right[(0, False)] + right.get((0, True), 0))


def test_passwords_of_letters_alone_and_words_behind_key_names(spark, forest):
    import random

    _, describer, fitted = forest
    rng, words = random.Random(31), sorted(w for w in describer.words if len(w) >= 6)
    rows = []
    for k in range(300):
        value = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(8, 14)))
        rows.append((k, f'we wrote\npassword = "{value}"\nand went', "s1", 1, value))
    for k in range(300, 600):
        value = rng.choice([rng.choice(words), f"{rng.choice(words)}_{rng.choice(words)}", f"{rng.choice(words)}.{rng.choice(words)}()"])
        rows.append((k, f"the token: {value} is\npassword = \"{value}\" here", "s2", 0, value))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kind int, value string")
    scored = secret_scan.score(secret_scan.findings(docs, describer), fitted).join(docs.select("doc_id", "kind"), "doc_id")
    right = {(r["kind"], r["is_secret"]): r["count"] for r in scored.groupBy("kind", "is_secret").count().collect()}
    assert right[(1, True)] >= 0.9 * 300 and right[(0, False)] >= 0.9 * (right[(0, False)] + right.get((0, True), 0))


def test_features_equal_a_plain_count(forest):
    _, describer, _ = forest
    for text, at, size, _ in planted_findings.planted(describer.words, 100, 5):
        value, before, after = text[at : at + size], text[max(0, at - 40) : at], text[at + size : at + size + 40]
        got = dict(zip(secret_scan.FEATURES, describer.features(value, before, after, "src", 0.25)))
        kinds = ["a" if c.isalpha() else "0" if c.isdigit() else "." for c in value]
        assert got["length"] == math.log(size) and got["position"] == 0.25
        assert got["digits"] == pytest.approx(kinds.count("0") / size) and got["signs"] == pytest.approx(kinds.count(".") / size)
        assert got["capitals"] == pytest.approx(sum(map(str.isupper, value)) / size)
        assert got["class_changes"] == pytest.approx(sum(x != y for x, y in zip(kinds, kinds[1:])) / size)
        shares = [n / size for n in Counter(value).values()]
        assert got["entropy"] == pytest.approx(-sum(p * math.log2(p) for p in shares))
        small = value.lower()
        steps = [describer.pairs.get((x, y), describer.rare) for x, y in zip(small, small[1:])]
        assert got["pair_likelihood"] == pytest.approx(sum(steps) / len(steps))
        covered = at_ = 0
        while at_ < size:
            fits = [k for k in range(size - at_, 2, -1) if small[at_ : at_ + k] in describer.words]
            covered, at_ = covered + (fits[0] if fits else 0), at_ + (fits[0] if fits else 1)
        assert got["coverage"] == pytest.approx(covered / size)


def test_words_of_all_documents_and_languages_are_counted(spark):
    # 6000 words of one language, each in many documents, and one rare word of another in the last document
    letters = "abcdefghijklmnopqrst"
    vocabulary = [a + b + c + "x" for a in letters for b in letters for c in letters][:6000]
    rows = [(k, " ".join(vocabulary[k % 60 * 100 : k % 60 * 100 + 100]), "en") for k in range(2400)] + [(9999, "þórð ýtti", "is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = secret_scan.fit_tables(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert known.words == {*vocabulary, "þórð", "ýtti"} and known.coverage("þórð") == 1.0 and ("þ", "ó") in known.pairs
    assert known.pairs["a", "x"] > known.rare and len(known.common) == secret_scan.COMMON_WORDS


KEY = "0123456789abcdef0123456789abcdef01234567"


@pytest.mark.parametrize("text, value", [
    ('password = "hunter2!"', "hunter2!"), ("pwd: s3cr#t$%", "s3cr#t$%"), ("DB_PASSWORD='a b&c d9'", "a b&c d9"),
    ('{"passwd": "x\\"y!z4"}', 'x\\"y!z4'), ("$c['db_password'] => 'pa$$w0rd'", "pa$$w0rd"), (f"API_KEY={KEY}", KEY),
    (f"see http://a.org/x?token={KEY}&page=2", KEY), (f"sha={KEY}", KEY), ("Authorization: Bearer ab!cd9", "ab!cd9"),
    (f"so token = \"{KEY}\".", KEY), ("secret: abc#def!ghi$jkl%mno&pqr1.", "abc#def!ghi$jkl%mno&pqr1"),
    ("password: token=abc!123", "abc!123"),
])
def test_candidates_are_the_values_alone(text, value):
    assert [(text.index(value), value)] == list(secret_scan.candidates(text))


def test_candidates_left_alone():
    assert list(secret_scan.candidates("password: short, token = \"abc\" and 12:30:45")) == []
    address = "https://www.example.org/some/long/path"
    assert list(secret_scan.candidates(address)) == [(0, address)]


def test_planted_passwords_are_found(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text", "lang", "source")
    planted = [(10**6 + k, f"we wrote it down here\npassword = \"{'Kq7' if k % 2 else 'zR4'}!{k}#x%\"\nand went home", "en", "s1") for k in range(60)]
    both = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string"))
    got = {r["doc_id"]: r for r in secret_scan.scan(both, None).filter("doc_id >= 1000000").collect()}
    for doc, text, *_ in planted:
        value = text.split('"')[1]
        assert got[doc]["digest"] == hashlib.sha256(value.encode()).hexdigest() and got[doc]["start"] == text.index(value)
        assert got[doc]["is_secret"] and got[doc]["length"] < 16


def test_findings_of_awkward_rows(awkward, labels):
    rows = secret_scan.scan(awkward[1], labels).collect()
    assert all(r["length"] >= 16 and 0 <= r["score"] <= 1 for r in rows) and {r["doc_id"] for r in rows} >= {14}


def test_shown_hashes_do_not_hold_their_whole_sets():
    texts = [" ".join(f"w{k}" for k in range(first, first + 200)).encode() for first in (0, 50, 400)] + [b"", b"one two"]
    found = jaccard_join.shown_hashes(texts, 5, 80)
    sets = jaccard_join.shingle_sets(texts, 5)
    assert [f.tolist() for f in found] == [s[: jaccard_join.shown(len(s), 80)].tolist() for s in sets]
    assert len(found[0]) < len(sets[0]) and all(f.base is None for f in found)
