import collections
import hashlib
import math
import random
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaloom.llm import arrow, bpe, html_extract, jaccard_join, lm_scoring, mixing, quality_classifier, quality_rules, substring_dedup, telephony, warc, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, id string, score double, row int"


def _text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


ODD = [None, "", " \t\n ", "one", "a b", "a b c", "Ünï çødé <|endoftext|> it's", "x" * 3000, _text(1, 400), _text(1, 400), _text(1, 399) + " changed", _text(2, 30000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, ("a", "b", None)[i % 3], None, "r", "i", 0.5, 1) for i, t in enumerate(ODD)]
    rows += [(None, "no id at all", None, None, None, "r", "i", 0.5, 1), rows[8]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _plain(t):
    return (t or "").encode().split()


def test_words_match_split():
    for data in (b"", b"a", b" a  bb\x0bc\n", b"y " * 200_000, b"z" * 300_000):
        h, a, z = words.hash_words(data)
        assert [data[i:j] for i, j in zip(a, z)] == data.split()
        again = {w: int(words.hash_words(w)[0][0]) for w in set(data.split())}
        assert h.tolist() == [again[w] for w in data.split()]


def test_arrow_batches_are_small(spark):
    docs = spark.range(48, numPartitions=1).select(F.repeat(F.col("id").cast("string"), 1 << 19).alias("text"))
    made = arrow.map_rows(docs, ["text"], "n long", lambda got: {"n": [sum(map(len, got["text"]))] * len(got["text"])}, 1000)
    assert max(r.n for r in made.collect()) <= 4 << 20


def test_workers_give_memory_back():
    def resident():
        return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    pins = []

    def run(batches):
        held = [b"x" * 20_000 for _ in range(4000)]
        pins.append(held[-1])  # keeps what lies below it from being trimmed unasked
        del held
        yield from batches

    before = resident()
    assert list(arrow.tidy(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 40


def test_bpe_memo_shares_ids():
    tokenizer = bpe.WordBpe(bpe.vocabulary_path())
    tokenizer.encode(" ".join(f"{a}q{b}nothing" for a in "jkqvxz" for b in "jkqvxz"))
    ids = [i for word in tokenizer.memo.values() for i in word]
    assert len({id(i) for i in ids}) == len(set(ids))


def test_bpe_equals_library(spark, odd, none):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    got = sorted(bpe.digests(odd, path).collect(), key=str)
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(r) if r[0] is None else str(r)) or sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    ids = bpe.encode(odd.filter("doc_id = 6"), path)
    assert bpe.decode(ids, path).first()["decoded"] == library.decode(ids.first()["ids"], skip_special_tokens=False)
    assert bpe.digests(none, path).count() == 0


def test_bpe_scan_equals_heap():
    t = bpe.load(bpe.vocabulary_path())
    for w in ("th" * 40, "queueing", "é" * 30, "a"):
        b = w.encode()
        assert t._by_scan([b], -(-len(b) // 4) * 4)[0] == t._by_heap(b)


def test_quality_classifier(spark, odd, none):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.score(odd, model)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["score"]
    got = got.collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert [r["text"] for r in quality_classifier.score(odd, model, out_col="TEXT").limit(0).collect()] == []
    assert quality_classifier.score(none.select("doc_id", "text"), model).count() == 0
    blank = quality_classifier.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(odd.select("text"), blank).collect()} == {0.5}


def test_quality_classifier_trains_on_whole_texts():
    """A text of more than 16,384 words has all its passages, and the sample is bounded by documents that fit whole."""
    long = _text(9, 20_000).encode()
    assert len(quality_classifier.passages(long)) == -(-20_000 // quality_classifier.PASSAGE)
    assert quality_classifier._that_fit([(1, 5), (2, 100), (3, 4), (4, 2)], 10) == [1, 3]


def test_quality_classifier_gradient():
    """Against finite differences."""
    rng = np.random.default_rng(2)
    model = quality_classifier.Model.start(3)
    model.p = {k: (v + rng.normal(size=v.shape) / 5).astype(np.float64) for k, v in model.p.items()}
    x, sizes, y = rng.normal(size=(9, quality_classifier.WIDTH)), np.array([4, 2, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -float(np.mean(y * np.log(s := model.forward(x, sizes)["score"]) + (1 - y) * np.log(1 - s)))
    grad = model.gradient(x, sizes, y, 0.0)
    for k, v in model.p.items():
        at = tuple(int(rng.integers(n)) for n in v.shape)
        kept = v[at]
        v[at] = kept + 1e-5
        up = loss()
        v[at] = kept - 1e-5
        down = loss()
        v[at] = kept
        assert math.isclose((up - down) / 2e-5, grad[k][at], rel_tol=1e-3, abs_tol=1e-7)


def test_quality_classifier_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    got = quality_classifier.op2_quality_classifier(spark, sf).filter("held_out")
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select((F.col("quality") == F.col("predicted")).cast("int").alias("ok"))
    assert both.agg(F.avg("ok")).first()[0] > 0.95


def test_mixing(spark, odd, none):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")
    rows = mixing.mix(docs).collect()
    sizes, targets, taken = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    want, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            want[s] = 2 * sizes[s]
            left -= want[s]
            open_.discard(s)
    want |= share
    for s in sizes:
        assert math.isclose(targets[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - want[s]) < 0.02 * want[s]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    small = mixing.mix(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"))
    for r in small.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) < 0.02 * r["target"]
    assert mixing.mixed(odd).columns == odd.columns


def test_mixing_ranks_by_odds(spark):
    """What is taken beyond the certain copies: the least odds divided by the odds of a chance in proportion to size, ties together."""
    rng = random.Random(4)
    rows = [(i, _text(i, rng.choice((3, 20, 90, 400))), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string, source string")
    found = {r["source"]: r for r in mixing.cuts(df).collect()}
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    uniform = {r[0]: r[1] for r in df.select("doc_id", mixing._uniform("doc_id", 7)).collect()}
    for source in "ab":
        of, words_ = found[source], {i: len(t.split()) for i, t, s in rows if s == source}
        if not of["rest"]:
            assert {got[i]["copies"] for i in words_} == {of["whole"]} == {2}
            continue
        chance = {i: min(1.0, (of["slope"] or 0) * 2 ** (round(4 * math.log2(n)) / 4)) for i, n in words_.items()}
        expected = sum(chance[i] * n * (3 if i == 0 else 1) for i, n in words_.items())
        assert math.isclose(expected, of["rest"], rel_tol=1e-9, abs_tol=1e-6)
        extra = {i for i in words_ if got[i]["copies"] > of["whole"]}
        odds = {i: uniform[i] / (1 - uniform[i]) * (1 - chance[i]) / chance[i] for i in words_}
        order = sorted(words_, key=odds.get)
        total, left = 0, set()
        for at, i in enumerate(order):
            total += words_[i] * (3 if i == 0 else 1)
            if total > of["rest"]:
                left = set(order[at:])
                break
        assert set(words_) - left <= extra
        taken = sum(words_[i] * (3 if i == 0 else 1) for i in extra)
        assert abs(taken - of["rest"]) <= min(words_.values())


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav>menu</nav>
<div class="cookie-notice">We use</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>
 words&nbsp;here<br><p>Second &#39;q&#39;<div class="ad">BUY</div><ul><li>one<li>two</ul></article>
<section id="comments"><p>nice</p></section><aside>side</aside><form>f<input></form><footer>foot</footer><script>var a="</p>";</script></body></html>"""


def test_html(spark, none):
    rows = [(1, "http://a/1", PAGE), (2, "http://a/2", None), (3, None, ""), (4, "x", "<p>cut &am"), (5, "http://a/3", "<div class='menu'>only</div>"), (6, "http://a/4", PAGE[: PAGE.index("</article>")] + "<p cla")]
    got = {r["page_id"]: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Title & more\nFirst bold words here\nSecond 'q'\none\ntwo"
    assert [got[i]["text"] for i in (2, 3, 4, 5)] == ["", "", "cut &am", ""]
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[6]["text"].startswith("Title & more")
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _texts(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [t for _, t in sorted((r["page_id"], r["text"]) for r in got)]


def test_html_cuts_at_a_container_only_where_all_else_repeats(spark):
    """Nested leads, split bodies, mixed layouts, copies of a page, against the article text of each page."""
    strip, pages, want = "Read more about us and our partners", [], []
    for i in range(4):
        title, lead, body = f"Title {i}", _text(300 + i, 6), _text(310 + i, 200)
        pages.append(("http://lead/", f"<body><div>{strip}</div><article><h1>{title}</h1><p>{lead}</p><div class=body><p>{body}</p></div></article></body>"))
        want.append(f"{title}\n{lead}\n{body}")
    for i in range(4):
        body = _text(320 + i, 100)
        pages.append(("http://mixed/", f"<body><div>{strip}</div><div class=body><p>{body}</p></div></body>"))
        want.append(body)
    few, many = _text(330, 10), _text(331, 90)
    pages.append(("http://mixed/", f"<body><div>{strip}</div><div class=body><p>{few}</p></div><div class=more><p>{many}</p></div></body>"))
    want.append(f"{strip}\n{few}\n{many}")
    for _ in range(4):
        pages.append(("http://copies/", f"<body><p>{few}</p><div class=body><p>{many}</p></div></body>"))
        want.append(f"{few}\n{many}")
    half = [_text(332, 100), _text(333, 100)]
    pages.append(("http://one/", f"<body><h1>Top</h1><div class=a>{half[0]}</div><div class=b>{half[1]}</div></body>"))
    want.append("\n".join(["Top", *half]))
    assert _texts(spark, pages) == want


def test_html_words_of_a_wrapper(spark):
    """Wrappers whose class or id has a word of boilerplate keep the article; boilerplate beside or inside it still goes."""
    body, few, other = _text(340, 120), _text(341, 20), _text(342, 60)
    side = "<div class=sidebar>side</div><section id=comments><article class='comment depth'>nice</article></section><p class='ad box'>buy</p>"
    pages, want = [], []
    for start in ("<div class='content with-sidebar'>", "<div class='no-sidebar'>", "<div class='social-science'>", "<div id='notice-of-change'>", "<div class=share-price-news>",
                  "<article class='comments-open'>", "<main class='has-comments'>", "<article class='ad-free'>", "<div class=sidebar><article>", "<div class=widget><main>"):
        end = "".join(f"</{x.split()[0]}>" for x in reversed(start.replace(">", "").split("<")[1:]))
        pages += [("", f"<body>{start}<p>{body}</p>{side}{end}</body>"), ("", f"<body>{start}<p>{body}</p>{end}{side}</body>")]
        want += [body, body]
    pages.append(("", "<body>" + "".join(f"<article class='post has-comments'>{_text(350 + i, 40)}</article>" for i in range(5)) + side + "</body>"))
    want.append("\n".join(_text(350 + i, 40) for i in range(5)))
    pages.append(("", f"<body><article>{few}</article><div class=related><article>{few[:40]}</article></div><div class=comments>{body}</div></body>"))
    want.append(few)
    for i in range(3):
        pages.append(("http://host/", f"<body><div class='content no-sidebar'>{_text(360 + i, 300)}</div></body>"))
        want.append(_text(360 + i, 300))
    pages.append(("http://host/", f"<body><div class='content no-sidebar'>{few}</div><p>{other}</p></body>"))
    want.append(f"{few}\n{other}")
    assert _texts(spark, pages) == want


def test_html_vote_drops_boilerplate_of_any_class(spark):
    """Boilerplate under classes that say nothing: links weigh nothing, and what repeats over a host stands outside the article."""
    links = "".join(f"<a href=/{i}>Section number {i} of the whole site</a> | " for i in range(40))
    pages, want = [], []
    for i in range(6):
        body = _text(500 + i, 60)
        pages.append(("http://zz/", f"<body><div class=qa>{links}</div><div class=qb><p>{body}</p></div><div class=qc>All rights are ours and ours alone</div></body>"))
        want.append(body)
    assert _texts(spark, pages) == want
    alone = _texts(spark, pages[:1])[0]
    assert alone != want[0] and want[0] in alone  # without the vote of its host a page keeps what may be article


def test_html_deep_pages_and_many_paths(spark):
    deep = lambda x: "<div class=w>" * 40 + x + "</div>" * 40
    pages, want = [], []
    for i in range(5):
        pages.append(("http://deep/", f"<body>{deep(f'<div class=side>See also our partners</div><div class=main>{_text(520 + i, 80)}</div>')}</body>"))
        want.append(_text(520 + i, 80))
    for kind in range(20):
        for i in range(4):
            name = "abcdefghijklmnopqrst"[kind]
            body = _text(600 + 4 * kind + i, 80)
            pages.append(("http://many/", f"<body><div class=x{name}>Strip of kind {name}</div><div class=m{name}>{body}</div></body>"))
            want.append(body)
    assert _texts(spark, pages) == want


def test_html_time_of_odd_markup():
    for page in ("<b>" * 120_000 + "</i>" * 120_000, "<b>" * 100_000 + "<h1></h1>" * 80_000, "<div>x" * 20_000, "<p>" + "<b>" * 100_000 + "<td>" * 100_000):
        began = time.time()
        html_extract.extract(page, None, set())
        assert time.time() - began < 5


def test_html_clashing_columns(spark):
    rows = [(1, "http://a/1", PAGE, "t", 5, "h", "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, host string, winners string")
    assert html_extract.main_text(df).first()["text"].startswith("Title & more")


def test_warc(spark, tmp_path):
    big, odd_page = "ab\r\n\r\nc" * 40_000, "é" * 600
    rows = [(1, "u", big), (2, "u 2", big), (3, None, None), (4, "u", ""), (5, "u", odd_page), (6, "u", odd_page), (7, "u", "x" * 999), (8, "u", "x" * 999), (None, "u", odd_page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.archive(pages, str(tmp_path / "a"), chunk=5000)
    chunks = spark.read.parquet(str(tmp_path / "a"))
    got = {r["id"]: r for r in warc.read_chunks(chunks).collect()}
    assert len(got) == 9 and got["1"]["record_type"] == "revisit" and got["1"]["refers_to"] == "2" and got["2"]["record_type"] == "response"
    assert got["5"]["refers_to"] == "6" and got[None]["refers_to"] == "6" and got["7"]["record_type"] == "response"
    for page, _, html in rows:
        r = got[None if page is None else str(page)]
        assert (r["payload_bytes"], r["payload_digest"]) == (len((html or "").encode()), hashlib.sha1((html or "").encode()).hexdigest())
    last = chunks.filter("n_chunks > 1").orderBy("record_id", "chunk_no").collect()
    assert b"".join(r["data"] for r in last).startswith(b"WARC/1.1\r\n")
    with pytest.raises(Exception, match="payload|place|chunks"):
        warc.read_chunks(chunks.filter("n_chunks = 1 OR chunk_no <> 3")).collect()


def test_warc_query_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(map(tuple, warc.op5_warc(spark, SF).collect())) == sorted(map(tuple, c.sql(warc.OP5_SQL).fetchall()))


def test_telephony(spark, odd, none):
    got = telephony.through_media(odd).collect()
    by_id = {r["doc_id"]: r for r in got}
    for r in odd.collect():
        payload, m = telephony.pad((r["text"] or "").encode()), by_id[r["doc_id"]]
        assert len(payload) % 64 == 0 and payload
        assert (m["n_bytes"], m["payload_bytes"], m["payload_sha256"]) == (len((r["text"] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert m["tail_crc32"] == zlib.crc32(payload[-64:])
        codec, n = telephony.codec_of(payload), len(payload)
        pcm = {"mulaw": telephony.expand_mulaw, "alaw": telephony.expand_alaw, "ima_adpcm": telephony.decode_adpcm}[codec](payload).astype(int).tolist()
        out = [x for a, b in zip([pcm[0], *pcm], pcm) for x in ((a + b) >> 1, b)]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:]))
        crc = zlib.crc32(np.array(out, "<i2").tobytes())
        assert m["feature"] == f"{codec}:16000:{len(out)}:{max(map(abs, out))}:{sum(x * x for x in out) // len(out)}:{crossings}:{crc:08x}"
    assert by_id[8]["feature"] == by_id[9]["feature"]
    assert telephony.through_media(none).count() == 0
    assert telephony.decode_media(telephony.store_text(odd), keep=("doc_id",)).filter("pcm IS NULL").count() == 0


def test_least_keys(spark):
    from deltaloom.llm.shared import least_keys

    keyed = spark.range(1000).withColumn("key", F.unhex(F.md5(F.col("id").cast("string"))))
    want = sorted((hashlib.md5(str(i).encode()).digest(), i) for i in range(1000))
    for n in (0, 1, 10, 100, 400, 2000):
        got = sorted(r["id"] for r in least_keys(keyed, "key", n, 1000).collect())
        assert set(got) <= {i for _, i in want[:n]} and (len(got) >= min(n, 1000) or n < 10)


def test_packed_pcm_is_lossless():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 7, 1000, 1001):
        for low, high in ((-32768, 32768), (-3, 3)):
            pcm = rng.integers(low, high, n).astype("<i2").tobytes()
            assert telephony.unpack_pcm(telephony.pack_pcm(pcm)) == pcm
    extremes = np.array([-32768, 32767, -32768, 32767, 32767, -32768], dtype="<i2").tobytes()
    assert telephony.unpack_pcm(telephony.pack_pcm(extremes)) == extremes
    resampled = np.concatenate(list(telephony.resample_twice(iter([telephony.MULAW, telephony.ALAW])))).tobytes()
    assert not any(telephony.pack_pcm(resampled)[len(resampled) // 2 :])


def test_telephony_media_in_portions(spark):
    rows = [(i, _text(i, 30 + i)) for i in range(23)]
    for parts in (1, 3, 9):
        got = telephony.through_media(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((r["doc_id"], r["payload_sha256"]) for r in got) == [(i, hashlib.sha256(telephony.pad(t.encode())).hexdigest()) for i, t in rows]


def test_telephony_codecs():
    codes = np.arange(256, dtype=np.uint8).tobytes()
    assert telephony.expand_mulaw(telephony.compress_mulaw(telephony.MULAW)).tolist() == telephony.MULAW.tolist()
    assert telephony.expand_alaw(codes)[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    pcm = (8000 * np.sin(np.arange(4000) / 30)).astype(np.int16)
    back = telephony.decode_adpcm(telephony.encode_adpcm(pcm))[:4000].astype(int)
    assert np.sqrt(np.mean((back - pcm) ** 2)) < 400
    value, index, data = 0, 0, bytes([0, 0, 0, 0, *range(60)])
    want = [0]
    for b in data[4:]:
        for code in (b & 15, b >> 4):
            step = int(telephony.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            want.append(value)
    assert telephony.decode_adpcm(data).tolist() == want


def _components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + min(k, len(w))]) for a in range(max(1, len(w) - k + 1))} if w else set()
    at = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((at[i], at[j]))
                at = {x: low if c == high else c for x, c in at.items()}
    return {i: (len(sets[i]), at[i]) for i in sets}


def test_jaccard_join(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.filter("doc_id IS NOT NULL").distinct().collect()]
    base = _text(5, 120).split()
    for i in range(40):  # a chain of near copies
        base[(3 * i) % 120] = f"n{i}"
        rows.append((100 + i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df, k=k, part=percent).collect()}
        assert got == _components(rows, k, percent)
    assert jaccard_join.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("k", "part"), [(3, 90), (5, 80), (1, 90)])
def test_jaccard_join_around_the_threshold(spark, k, part):
    """Groups of texts around a core, their similarities on both sides of the threshold, against all pairs."""
    made, texts = random.Random(3), []
    for g, size in enumerate((30, 60, 150)):
        for _ in range(40):
            t = [f"g{g}w{i}" for i in range(size)]
            for _ in range(made.randint(0, 4)):
                t[made.randrange(size)] = f"y{g}{made.randrange(4)}" if made.random() < 0.4 else f"x{made.random()}"
            texts.append(" ".join(t))
    made.shuffle(texts)
    sets = [{tuple(w[a : a + k]) for a in range(len(w) - k + 1)} for w in map(str.split, texts)]
    least = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if least[a] != least[b] and 100 * both >= part * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    got = jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=k, part=part)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == {i: (len(s), least[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_one_of_each_keeps_one_row(spark, kind):
    """Repeated rows, copies without an id, unlike texts of one id, and what the next stage leaves of them."""
    t = [_text(400 + i, 100) for i in range(8)]
    near = t[0].rsplit(" ", 2)[0] + " other end"
    rows = [(1, t[0], "a"), (1, t[0], "a"), (1, t[0], "b"), (2, t[0], "a"), (None, t[0], "a"), (None, near, "a"), (3, near, "a")]
    rows += [(4, t[1], "a"), (4, t[1], "a"), (5, t[2], "a"), (5, t[3], "a"), (5, t[3], "a"), (6, t[3], "a"), (None, t[4], "a"), (None, t[4], "a")]
    rows += [(None, t[5], "a"), (7, t[6], "a"), (8, None, "a"), (8, None, "a"), (9, "", "a"), (None, None, "a"), (None, None, "a"), (None, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(5)
    got = jaccard_join.one_of_each(df)
    assert got.schema == df.schema
    kept = [(None if i is None else int(i), x) for i, x, _ in got.collect()]
    want = [(1, t[0]), (4, t[1]), (5, t[2]), (6, t[3]), (None, t[4]), (None, t[5]), (7, t[6]), (8, None), (9, ""), (None, None), (None, "")]
    assert sorted(kept, key=str) == sorted(want, key=str)
    left = [r["text"] for r in substring_dedup.without_repeats(got).collect()]
    assert sorted(x for x in left if x) == sorted(x for _, x in want if x)


def test_partenum_loses_no_pair():
    rng = np.random.default_rng(5)
    for percent in (90, 80):
        found = 0
        for _ in range(1500):
            n = int(rng.integers(1, 300))
            parts = [words.mix(rng.integers(1, 2**62, int(m), dtype=np.uint64)) for m in (n, rng.integers(0, n // 8 + 2), rng.integers(0, n // 8 + 2))]
            a, b = (np.unique(np.concatenate([parts[0], p])) for p in parts[1:])
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                found += 1
                common = np.sort(parts[0][: n // 5])
                for skip in (None, common):
                    assert len(np.intersect1d(*(jaccard_join.signatures(x, percent, 100, skip) for x in (a, b))))
        assert found > 200


def _without_repeats(rows, w):
    count = collections.Counter()
    for t in rows:
        x = _plain(t)
        count.update(tuple(x[a : a + w]) for a in range(len(x) - w + 1))
    out = []
    for t in rows:
        x = _plain(t)
        gone = {j for a in range(len(x) - w + 1) if count[tuple(x[a : a + w])] > 1 for j in range(a, a + w)}
        out.append((len(x), len(gone), hashlib.sha256(b" ".join(y for j, y in enumerate(x) if j not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group", [16_384, 2])
def test_substring_dedup(spark, odd, none, group):
    passage = _text(77, 60)
    texts = [r["text"] for r in odd.collect()] + [f"{_text(i, 50)} {passage} {_text(i + 50, 40)}" for i in range(200, 208)] + ["ha " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r)[1:] for r in substring_dedup.substring_dedup(df, group=group).collect()) == _without_repeats(texts, 35)
    assert substring_dedup.substring_dedup(none).count() == 0
    assert substring_dedup.without_repeats(odd).columns == odd.columns


@pytest.mark.parametrize("group", [16_384, 3])
def test_substring_dedup_periodic_texts(spark, group):
    """Runs of few words, inside one text and across texts and repeated rows, against every window."""
    made = random.Random(9)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(made.randint(1, 4)):
            period = [f"p{made.randrange(3)}" for _ in range(made.randint(1, 12))]
            parts += (period * 40)[: made.randint(1, 90)] + [f"u{made.random()}"] * made.randrange(2)
        texts.append(" ".join(parts))
    texts += [" ".join(made.choice("ab") for _ in range(300)) for _ in range(10)] + [None, ""]
    rows = list(enumerate(texts))
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows + rows[:2], "doc_id long, text string").repartition(5), group=group)
    assert sorted(tuple(r)[1:] for r in got.collect()) == _without_repeats(texts + texts[:2], 35)


def test_lm_scoring_by_brute_force(spark):
    """The interpolated score: counts, deleted estimates, expectation-maximisation by bucket, mixture."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows}
    tokens = {i: [*t.split(), "</s>"] for i, t in rows}
    one, two = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if train[i]:
            one.update(t)
            two.update(zip(["<s>", *t], t))
    n, v, docs = sum(one.values()), len(one), sum(train.values())
    context = lambda w, less: (docs if w == "<s>" else one[w]) - less
    events = collections.defaultdict(collections.Counter)
    step = lambda p: 2.0 ** (-round(-lm_scoring.STEPS * math.log2(p)) / lm_scoring.STEPS) if p > 0 else 0.0
    for i, t in tokens.items():
        for a, b in zip(["<s>", *t], t) if train[i] else ():
            c = context(a, 1)
            pair = (two[a, b] - 1) / c if c > 0 else 0.0
            events[int(math.log2(max(c, 0) + 1))][step(pair), step((one[b] - 1) / (n - 1))] += 1
    weights = {}
    for bucket, seen in events.items():
        w = [0.3, 0.5, 0.2] if bucket else [0.0, 0.8, 0.2]
        for _ in range(60):
            new = [0.0, 0.5, 0.5]
            for (p, q), times in seen.items():
                share = [w[0] * p, w[1] * q, w[2] / (v + 1)]
                new = [x + times * s / sum(share) for x, s in zip(new, share)]
            w = [x / sum(new) for x in new]
        weights[bucket] = w
    for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t, want = tokens[r["doc_id"]], 0.0
        for a, b in zip(["<s>", *t], t):
            c = context(a, 0)
            w = weights.get(int(math.log2(max(c, 0) + 1)), [0.3, 0.5, 0.2] if c else [0.0, 0.8, 0.2])
            want += math.log10(w[0] * (two[a, b] / c if c else 0) + w[1] * one[b] / n + w[2] / (v + 1))
        assert math.isclose(r["score"], want, rel_tol=1e-6)


@pytest.mark.parametrize("bucket_keys", [3_000_000, 500])
def test_lm_scoring(spark, odd, none, bucket_keys):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    train = collections.Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*(t or "").encode().lower().split(), None])
    n, v = sum(train.values()), len(train)
    for r in lm_scoring.score(odd, bucket_keys=bucket_keys).collect():
        x = [*(dict(rows)[r["doc_id"]] or "").encode().lower().split(), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(train[w] > 0 for w in x), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
        assert r["score"] <= 0
    assert lm_scoring.score(none).count() == 0


def test_quality_rules(spark, odd, none):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    for i, t in ((r["doc_id"], r["text"]) for r in odd.collect()):
        w, lines, dup = _plain(t), set(), 0
        count = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {j for a in range(len(w) - 2) if count[tuple(w[a : a + 3])] > 1 for j in range(a, a + 3)}
        for line in (t or "").split("\n"):
            if line.encode().split():
                dup += line in lines
                lines.add(line)
        r = got[i]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), dup, len(inside))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(none).count() == 0


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, against plain versions."""
    import sys
    from pathlib import Path

    from tokenizers import Tokenizer

    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    passage, rows = _text(900, 40), []
    for i in range(60):
        t = _text(1000 + i, 120)
        rows.append((i, f"{t} {passage}" if i % 6 == 0 else t))
    rows += [(60 + i, rows[i][1]) for i in range(5)] + [(70 + i, rows[i][1].rsplit(" ", 3)[0] + " other end") for i in range(8, 12)]
    rows += [(90, None), (91, ""), (92, "few words"), (93, rows[20][1])]
    full = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(full + full[-1:], columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    steps = {}
    for name, stage in list(stages.items())[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = quality_classifier.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    want = [(i, t) for i, t, *_ in full + full[-1:] if quality_classifier._score_texts(model, [t and t.encode()])[0] >= 0.3]
    assert sorted(steps["quality_classifier"], key=str) == sorted(want, key=str) and len(want) > 50
    of = _components(sorted(set(want), key=str), 5, 80)
    assert sorted(steps["jaccard_join"], key=str) == sorted({(i, t) for i, t in want if of[i][1] == i}, key=str)
    x = steps["jaccard_join"]
    count = collections.Counter(tuple(w[a : a + 35]) for _, t in x for w in [_plain(t)] for a in range(len(w) - 34))
    for i, t in x:
        w = _plain(t)
        gone = {j for a in range(len(w) - 34) if count[tuple(w[a : a + 35])] > 1 for j in range(a, a + 35)}
        left = b" ".join(y for j, y in enumerate(w) if j not in gone).decode() if gone else t
        assert (i, left) in steps["substring_dedup"]
    assert len(x) == len(steps["substring_dedup"]) and any("w" in (t or "") and passage not in (t or "") for _, t in steps["substring_dedup"])
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "substring_dedup"))).collect()}
    assert collections.Counter(i for i, _ in steps["mixing"]) == collections.Counter({i: n for i, n in mixed.items() if n})
    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in stages["bpe"](spark, docs, str(tmp_path)).collect())
    assert got == collections.Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in steps["mixing"])
