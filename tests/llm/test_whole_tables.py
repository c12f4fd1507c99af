"""Long and odd input, clashing columns, and the operators without SQL against brute force over whole tables."""

import collections
import os
import random
import re
import time
import tracemalloc
import types
import weakref

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldglass.llm import common, decontamination, html, langid, neighbours, packing, pii, queries, repeats, simhash, tokenize, urls
from fieldglass.llm.common import utf8_view

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def column(table, name):
    return pq.read_table(f"{DATA}/{table}.parquet").column(name).to_pylist()


# Long texts.
@pytest.mark.parametrize("name, drop", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_more_distinct_pieces_than_are_remembered(monkeypatch, name, drop):
    monkeypatch.setattr(tokenize, "REMEMBERED", 50_000)
    monkeypatch.setattr(tokenize, "PORTION", 1 << 17)
    path = public_tokenizers.path(name)
    text = " ".join(f"w{i:x}q" for i in range(150_000)) + " " + "y" * 400_000
    texts = ["first a", text, None, "", "last é<|endoftext|>z"]
    coder, plain = tokenize.PieceEncoder(path, drop, added=True), Tokenizer.from_file(path)
    ids, edges = coder.encode(*utf8_view(pa.array(texts, pa.string())), 1)
    for k, t in enumerate(texts):
        assert ids[edges[k] : edges[k + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 1]


def test_portions_may_end_anywhere(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(1)
    texts = ["".join(rng.choice(["a", "é", " ", "\n", "!", "'", "s", "1", "×", "日", "Z"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for size in (1, 5, 33):
        monkeypatch.setattr(tokenize, "PORTION", size)
        ids, edges = tokenize.PieceEncoder(path, False, True).encode(*utf8_view(pa.array(texts)), 1)
        assert all(ids[edges[k] : edges[k + 1]].tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(texts))


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = tokenize.PieceEncoder(path, False, True)
    coder._find = lambda hashes, find=coder._find: np.where(np.arange(len(hashes)) >= 0, np.maximum(find(hashes), -1) * 0 + (0 if coder.known else -1), 0)
    coder.encode(*utf8_view(pa.array(["one"])))
    ids, _ = coder.encode(*utf8_view(pa.array(["other words"])))
    assert ids.tolist() == Tokenizer.from_file(path).encode("other words", add_special_tokens=False).ids


@pytest.mark.parametrize("page", ["<a " * 70_000, '<a ">" ' * 30_000, "<b>" * 60_000 + "</i>" * 60_000, "<p><button>" + "<ul>" * 20_000 + "<div></div>" * 20_000, "<style>" + "</style " * 30_000, "<div>" + "<p>x</p>" * 40_000, "<a '" * 50_001 + ">"])
def test_pages_are_read_in_linear_time(page):
    began = time.process_time()
    html.subtree_contexts(page)
    html.main_text(page, {1})
    assert time.process_time() - began < 20  # a second or two; a quadratic reader takes minutes


def test_long_documents_through_every_operator(spark, tmp_path):
    rng = random.Random(2)
    long = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(120_000))
    docs = spark.createDataFrame([(1, long, "en"), (2, "short one", "en"), (3, long + " x", "en"), (4, None, None), (5, "", "de")], "doc_id long, text string, lang string").repartition(2)
    bench = spark.createDataFrame([(1, long[:4000])], "item_id long, text string")
    removed = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert removed[3].n_removed == len(long) and removed[1].n_removed == 0
    assert {r.doc_id: r.contaminated for r in decontamination.judge(docs, bench).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    groups = {r.doc_id: r.component_id for r in simhash.groups(docs, **simhash.NEAR).collect()}
    assert groups[3] == 1 and groups[2] == 2
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)
    assert {r.doc_id: (r.n, r.t) for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()}[4] == (1, 1)
    assert pii.redact(docs).count() == 5 and langid.predict(docs, langid.train(langid.sample(docs))).count() == 5


# Clashing columns.
CLASHES = ("doc", "spans", "wanted", "bucket", "part", "kind", "blob", "_doc", "kept", "more", "label", "dims", "raw", "size", "leaf", "block", "mine", "n", "vec", "host", "_own", "_templates", "hash", "rule", "own", "key", "path", "bad", "a", "b", "node", "component", "_changed", "surrogate", "share", "most", "hit_doc", "_hit_doc", "_dropped", "fp", "sketch")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASHES if c not in df.columns})


def test_extra_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of some words here and there " * 3, "en" if i % 2 else "fr") for i in range(30)], "doc_id long, text string, lang string")
    wide, bench = clashing(docs), spark.createDataFrame([(1, "number 3 of some words here and there text number 3")], "item_id long, text string")
    same = lambda f: sorted(map(tuple, f(docs).collect())) == sorted(map(tuple, f(wide).collect()))
    model = langid.train(langid.sample(wide))
    assert same(repeats.remove_repeats) and same(lambda d: langid.predict(d, model)) and same(lambda d: simhash.groups(d)) and same(lambda d: decontamination.judge(d, clashing(bench)))
    for stage in (lambda d: langid.keep_identified(d, model), simhash.deduplicate, lambda d: decontamination.remove_documents(d, bench), lambda d: decontamination.remove_spans(d, bench), pii.redact):
        assert stage(wide).columns == wide.columns and sorted(tuple(r)[:3] for r in stage(wide).collect()) == sorted(tuple(r) for r in stage(docs).collect())
    assert pii.redact(wide, count="n").columns == [c for c in wide.columns if c != "n"] + ["n"]
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0], 0) for i in range(9)], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([(i, f"http://a.net/es/{i}", f"<p>own {i}</p><p>the same on each</p>") for i in range(12)], "page_id long, url string, html string")
    assert sorted(map(tuple, neighbours.near_duplicates(vectors).collect())) == sorted(map(tuple, neighbours.near_duplicates(clashing(vectors)).collect()))
    assert sorted(map(tuple, urls.judge(pages).collect())) == sorted(map(tuple, urls.judge(clashing(pages)).collect()))
    assert sorted(map(tuple, html.extract(pages, html.templates(pages)).collect())) == sorted(map(tuple, html.extract(clashing(pages), html.templates(clashing(pages))).collect()))


# Personal data.
def test_masked_and_foreign_secrets(spark):
    texts = ["login: x password: ********", "token = 密码密码密码密码", "Mr Øø", "Mary Smith wrote to John Brown. Mary left.", "at 10.0.0.1 and 192.168.7.1", "4111 1111 1111 1111 and 5755695738806562"]
    rows = {r.doc_id: r for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), count="n", cards="valid").collect()}
    assert rows[0].text == texts[0] and rows[0].n == 0
    assert rows[1].n == 1 and "密码" not in rows[1].text and len(rows[1].text) == len(texts[1])
    assert rows[2].text != texts[2] and rows[2].text[3:].isalpha()
    given = rows[3].text.split()[0]
    assert rows[3].n == 3 and not re.search("Mary|Smith|John|Brown", rows[3].text) and rows[3].text.endswith(f"{given} left.") and given in pii.GIVEN[1]
    assert rows[4].text.startswith("at 10.") and " 192.168." in rows[4].text and rows[4].text != texts[4]
    assert rows[5].text.endswith(" and 5755695738806562") and not rows[5].text.startswith("4111")


def test_the_key_decides(spark):
    spark.conf.set(pii.KEY_SETTING, "one")
    one = pii.replaced("ann@mail.de")[0]
    spark.conf.set(pii.KEY_SETTING, "two")
    two = pii.replaced("ann@mail.de")[0]
    spark.conf.unset(pii.KEY_SETTING)
    assert one != two and one.endswith(".de") and pii.replaced("ann@mail.de", b"k") == pii.replaced("ann@mail.de", b"k")


@pytest.mark.parametrize("limit", [50_000, 0])
def test_collisions_are_mended(spark, monkeypatch, limit):
    """Every two-letter name there is: each surrogate is a real entity, so some stay; none is shared or its own."""
    monkeypatch.setattr(pii, "BROADCAST_ROWS", limit)
    weak = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda kind, entity, key=None, attempt=0: "4.4.4.4" if kind == "ip" and not attempt and entity.startswith("8.8.8.") else weak(kind, entity, key, attempt))
    ips = [f"8.8.8.{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, f"{ip} and again {ip}") for i, ip in enumerate(ips)] + [(99, "1.2.3.4")], "doc_id long, text string")
    mended = pii.settled(docs, b"k").collect()  # the driver's first attempts are not patched on the workers
    rows = [r.text.split() for r in pii.redact(docs, b"k").where("doc_id < 99").collect()]
    assert all(r[0] == r[3] for r in rows) and len({r[0] for r in rows}) == 30 and not {r[0] for r in rows} & set(ips)
    assert all(r.surrogate not in ips for r in mended)


def test_full_domains_keep_apart(spark):
    names = [a + b for a in "AEIOU" for b in "aeiou"]
    docs = spark.createDataFrame([(i, f"Mr {n} came") for i, n in enumerate(names)], "doc_id long, text string")
    new = [r.text.split()[1] for r in pii.redact(docs, b"k").orderBy("doc_id").collect()]
    assert len(set(new)) == len(names) and all(a != b for a, b in zip(new, names, strict=True))


@needs_tables
def test_surrogates_of_a_whole_table(spark):
    """Distinctness and coreference over every mention of a table, found by reading old and new texts side by side."""
    texts = [t or "" for t in column("documents", "text")]
    new = {r.doc_id: r.text for r in queries.QUERIES["op2_surrogates"](spark, DATA).collect()}
    mapped, seen = {}, 0
    for doc, old in zip(column("documents", "doc_id"), texts, strict=True):
        at = shift = 0
        for a, z, kind, entity in pii.mentions(old, "valid"):
            assert new[doc][at + shift : a + shift] == old[at:a]  # nothing else changes
            rest = [x for x in pii.mentions(new[doc], "valid")]
            b, y = next((b, y) for b, y, _, _ in rest if b == a + shift)
            for word, other in zip(*(x.split(" ") if kind == "person" else [x] for x in (old[a:z], new[doc][b:y])), strict=True):
                assert mapped.setdefault((kind, word.lower()), other.lower()) == other.lower() and word.lower() != other.lower()
            at, shift, seen = z, y - z, seen + 1
        assert new[doc][at + shift :] == old[at:]
    assert seen > 20 and len({(k, v) for (k, _), v in mapped.items()}) == len(mapped)


# Languages.
@needs_tables
def test_languages_of_a_whole_table(spark):
    lang = dict(zip(column("documents", "doc_id"), column("documents", "lang"), strict=True))
    rows = [r for r in queries.QUERIES["op3_language"](spark, DATA).collect() if r.held_out and lang[r.doc_id]]
    assert len(rows) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.95


def test_training_and_prediction_read_texts_alike():
    for text in ("ΣΑΣ ΌΔΟΣ", "İstanbul IŞIK", "ẞ Straße"):
        (a, x), (b, y) = langid.lowered([text]), langid.lowered(pa.array([text]))
        assert a.tolist() == b.tolist() and x.tolist() == y.tolist()


def test_long_texts_stay_out_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "LONGEST", 100)
    rows = [(i, "word " * (5 if lang == "a" else 50 + i), lang) for i, lang in enumerate("ab" * 40)] + [(900, "long " * 500, "a")]
    found = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for lang, _ in found} == {"a", "b"} and max(len(t) for lang, t in found if lang == "a") <= 100 and len({t for lang, t in found if lang == "b"}) == 1


@pytest.fixture(scope="module")
def two_languages():
    rng = random.Random(31)
    stock = {"aa": ["bana", "mora", "tilu", "sena"], "bb": ["kritz", "vrost", "gnalk", "pfünd"]}
    return langid.train([(lang, " ".join(rng.choice(stock[lang]) for _ in range(30))) for lang in ["aa", "bb"] * 40])


@pytest.mark.parametrize("texts", [["bana kritz, mora vrost. " * 1400] * 64, ["bana kritz, mora vrost. " * 90_000]])
def test_scoring_takes_little_memory(two_languages, texts):
    data, bounds = langid.lowered(texts)  # about the 2 MB that a kernel gets at once
    tracemalloc.start()
    two_languages.scores(data, bounds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


@pytest.mark.parametrize("portion", [1, 2, 5, 64, 1000])
def test_portions_of_texts_score_like_whole_texts(two_languages, monkeypatch, portion):
    texts = ["bana kritz", "", None, "a", "é", "pfünd, vrost! " * 40, "banamoratilu" * 60, " ", "Tilu", None]
    data, bounds = langid.lowered(pa.array(texts, pa.string()))
    buckets, edges = langid.subwords(data, bounds)
    seen = [two_languages.seen[buckets[a:b]].mean() if b > a else 0 for a, b in zip(edges, edges[1:])]
    want = two_languages.scores(data, bounds)
    monkeypatch.setattr(langid, "PORTION", portion)
    found = two_languages.scores(data, bounds)
    assert np.allclose(found[0], want[0], atol=1e-12) and (found[1] == want[1]).all() and np.allclose(found[1], seen)
    assert two_languages.scores(*langid.lowered(pa.array([], pa.string())))[0].shape == (0, 2)


@pytest.mark.parametrize("stage", [lambda docs: langid.keep_identified(docs, None), lambda docs: common.text_map(docs, lambda part: part, "text string")])
def test_workers_do_not_keep_the_tokens_of_another_operator(stage):
    context = types.SimpleNamespace(broadcast=lambda model: types.SimpleNamespace(value=model))
    docs = types.SimpleNamespace(sparkSession=types.SimpleNamespace(sparkContext=context), schema=None, mapInArrow=lambda run, schema: run)
    kept = weakref.ref(tokenize.encoder(public_tokenizers.path("byte_bpe_50k.json")))
    assert kept() is tokenize.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(list(stage(docs)(iter([pa.RecordBatch.from_pydict({"text": ["some", None]})])))) == 1
    assert kept() is None


# Decontamination beyond a broadcast.
def test_a_set_too_large_to_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["the", "of", "and", "tion", "er", "é", "a", "THE", "x1"]) for _ in range(n))
    items = [words(25), words(12), "rare é9 Pair", "", None, "one"]
    texts = [words(rng.randint(0, 60)) for _ in range(30)] + [f"start, {items[0]}. end", f"{items[1].upper()}!", "a rare--É9 pair", "a rare é9 pair", None, "", "One"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, items[1])], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted(map(str, decontamination.judge(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    judged = decontamination.judge(docs, bench)
    assert sorted(map(str, judged.collect())) == want and judged.where("contaminated").count() >= 5
    plan = decontamination.hits(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and re.search(r"Exchange hashpartitioning\(hash", plan)
    assert decontamination.judge(docs, bench.limit(0)).where("contaminated").count() == 0


# Pages.
def brute_templates(pages, least=10, few=3):
    """Hashes of the outermost blocks that markup calls no content, by host and number of pages."""
    counts, sizes = collections.Counter(), collections.Counter()
    for url, page in pages:
        host = re.match(r"[^:]*://([^/?#]*)", url or "")
        host = host[1].lower() if host else ""
        sizes[host] += 1
        counts.update({(host, h) for h, (kind, _) in html.subtree_contexts(page).items() if kind == 4})
    return {k for k, n in counts.items() if n >= least or (n >= few and 2 * n >= sizes[k[0]])}


@needs_tables
def test_templates_of_a_whole_table(spark):
    pages = list(zip(column("pages", "url"), column("pages", "html"), strict=True))
    table = queries.table(spark, DATA, "pages")
    found = {(r.host, r.hash) for r in html.templates(table).collect()}
    marked = {h for _, page in pages for h, (kind, _) in html.subtree_contexts(page).items() if kind == 4}
    assert {x for x in found if x[1] in marked} == brute_templates(pages)


def test_site_blocks_go_whatever_their_markup(spark):
    """Menus, notices and footers in plain div elements: only their recurrence tells them from prose."""
    rng = random.Random(4)
    prose = [" ".join(f"w{rng.randrange(9000)}" for _ in range(50)) for _ in range(60)]
    pages = [(i, f"http://site{i % 2}.org/{i}", f"<div><p>Home and products of site {i % 2}, all of them</p></div><div><p>{p}</p></div><div><p>All rights of site {i % 2} reserved for ever</p></div>") for i, p in enumerate(prose)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = {r.page_id: r for r in html.extract(df, html.templates(df)).collect()}
    assert all(rows[i].text == p and rows[i].n_templates == 2 for i, p in enumerate(prose))


# Urls.
def test_links_against_sql_and_brute_force(spark, tmp_path):
    rng = random.Random(5)
    hosts = ["a.org", "b.org", "x.example.com", "www.example.com", "bad.net", "c.net"]
    place = lambda: f"{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'x'])}/{rng.randrange(25)}{rng.choice(['', '', '?q=1'])}"
    rows = []
    for i in range(300):
        to = rng.choice(["", "", "https://" + place(), "//" + place(), f"/fr/{rng.randrange(25)}", f"{rng.randrange(25)}", "?q=1"])
        head = f'<LINK class=x href="{to}" rel=canonical>' if to and rng.random() < 0.6 else f'<meta http-equiv="refresh" content="0; url={to}">' if to else ""
        rows.append((i, rng.choice(["http://", "https://"]) + place(), f"<html><head><link rel=stylesheet href=s.css>{head}</head></html>"))
    rows += [(900, None, rows[0][2]), (901, "no scheme", rows[0][2]), (902, "http://a.org/z", None)] + rows[:1]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op9_urls"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = db.execute(queries.SQL["op9_urls"])
    names = [c[0] for c in found.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got))) == sorted(map(repr, found.fetchall()))

    def split(rest):
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        return host.lower(), path

    def own(rest):
        host, path = split(rest)
        fit = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1] if fit else None

    linked = collections.defaultdict(set)
    for _, url, page in rows:
        m = re.search(r'href="([^"]+)" rel|url=([^"]+)"', page or "")
        if not m or not url or "://" not in url:
            continue
        rest = url.split("://")[1]
        to = m[1] or m[2]
        base = rest.split("?")[0]
        target = to.split("://")[1] if "://" in to else to[2:] if to.startswith("//") else base.split("/")[0] + to if to.startswith("/") else base + to if to.startswith("?") else base.rpartition("/")[0] + "/" + to
        linked[rest].add(target)
        linked[target].add(rest)
    blocked = 0
    for r in got:
        url = next(u for i, u, _ in rows if i == r.page_id)
        if not url or "://" not in url:
            assert (r.host, r.path, r.rule, r.verdict) == ("", "", None, "allow")
            continue
        rest = url.split("://")[1]
        seen, todo = {rest}, [rest]
        while todo:
            for x in linked[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        want = own(rest) or ("block" if any(own(x) == "block" for x in seen) else "allow")
        blocked += want == "block" and not own(rest)
        assert r.verdict == want and (r.host, r.path) == split(rest)
    assert blocked > 20


# Shared parts.
def test_no_cluster_without_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://elsewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(Session())
    folder = common.scratch(spark, "test")
    spark.range(3).write.parquet(folder)
    assert spark.read.parquet(folder).count() == 3
    common.remove(spark, folder)
    assert not os.path.exists(folder.removeprefix("file:"))
