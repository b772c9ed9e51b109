"""Brute force, round trips and odd inputs for the corpus operators."""

import hashlib
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.llm import chat_format, html_text, media_columns, mixing, near_copies, packing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, _k1 string, id string"
RND = random.Random(11)
WORDS = [f"w{i}" for i in range(60)] + ["été", "naïve", "x" * 40]


def texts():
    base = [" ".join(RND.choices(WORDS, k=RND.randrange(60, 200))) for _ in range(12)]
    shared = " ".join(RND.choices(WORDS, k=150))
    rows = [b + "\n" + shared + "\n" + b[:50] for b in base[:5]] + base + [base[7]] * 3 + [base[8] + " end", "", None, "one", " \n\t", "ab" * 600, "long " * 4000]
    return [(i if i != 3 else None, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", 0, "c", "k", "i") for i, t in enumerate(rows)] + [(99, base[2], "en", "s0", 0, "c", "k", "i")] * 2


ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_suffix_sort():
    rnd = random.Random(3)
    for _ in range(200):
        ss = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 12))) for _ in range(rnd.randrange(1, 20))]
        assert [ss[k] for k in suffix_dedup.deep_shallow(ss, rnd.choice([0, 8]))] == sorted(ss)


@pytest.mark.parametrize("wide", [4096, 1])
def test_suffix_dedup(docs, none, wide):
    raw = [(t or "").encode() for _, t, *_ in ROWS]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    told = []
    for (k, *_), b in zip(ROWS, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        told.append((str(k), len(b), sum(gone), bytes(b"\0" + gone).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(docs, wide=wide).select("doc_id", "_d.*").collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4]) for r in got) == sorted(told)
    assert suffix_dedup.digests(none).count() == 0


def test_substring_dedup(docs, none):
    split = [(t or "").encode().split() for _, t, *_ in ROWS]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    told = []
    for (k, *_), w in zip(ROWS, split):
        gone = [0] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [1] * 35
        told.append((str(k), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    got = substring_dedup.repeated_word_windows(docs, chunk_bytes=8000, bucket_hashes=300).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(told)
    assert substring_dedup.repeated_word_windows(none).count() == 0


def test_simhash(docs, none):
    got = simhash_dedup.near_groups(docs, tile=4).collect()
    fp = np.array([int(r["fingerprint"], 16) for r in got], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    reach = near.copy()
    for _ in range(6):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    ids = [r["doc_id"] for r in got]
    for i, r in enumerate(got):
        assert r["component_id"] == min((ids[j] for j in np.flatnonzero(reach[i]) if ids[j] is not None), default=None)
    assert simhash_dedup.near_groups(none).count() == 0
    zero = [r["fingerprint"] for r in got if r["doc_id"] in [k for k, t, *_ in ROWS if not (t or "").split()]]
    assert set(zero) == {"0" * 16}


@pytest.mark.parametrize("held", [2_000_000, 600])
def test_near_copies(spark, none, held):
    """Pairs planted at resemblance 0.7 to 0.95 fall together exactly from 0.8 on, and so does the pipeline's stage."""
    import corpus_pipeline

    rnd, rows = random.Random(5), []
    for at in range(60):
        words = [f"v{rnd.randrange(5000)}" for _ in range(rnd.choice([24, 60, 250, 900]))]
        rows.append((2 * at, " ".join(words)))
        for k in rnd.sample(range(len(words)), max(1, int(len(words) * rnd.uniform(0.004, 0.036)))):
            words[k] = f"n{at}"
        rows.append((2 * at + 1, " ".join(words).upper()))
    rows += [(200, "the line " * 90), (201, "the line " * 9), (202, None), (203, " "), (204, "one two"), (205, "ONE  two"), (None, rows[0][1])]

    def bag(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [bag(t) for _, t in rows]
    root, near = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            near += [alike] * (0.8 <= alike < 0.95)
            if alike >= 0.8:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert len(near) >= 10 and len(set(root)) > 62
    told = {k: min(rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None) for i, (k, _) in enumerate(rows)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df, tile=16, held=held).collect()} == told
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(told.values()))
    assert near_copies.near_copies(none).count() == 0


def base_counts(text):
    """The contract of op7 by plain loops: words, their characters, symbols, repeated lines, words in repeated windows."""
    cut_at = {" ", *map(chr, range(9, 14))}
    words, lines, again = [[]], set(), 0
    for c in text or "":
        words.append([]) if c in cut_at else words[-1].append(c)
    words = ["".join(w) for w in words if w]
    for line in (text or "").split("\n"):
        if any(c not in cut_at for c in line):
            again += line in lines
            lines.add(line)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(marked)


def kneser_ney(texts, order):
    """Modified Kneser-Ney by plain dictionaries: log probability of every unit after its order - 1 predecessors."""
    padded = [(0,) * (order - 1) + tuple(int.from_bytes(x[i : i + 2], "little") for i in range(0, len(x), 2)) for x in ((t or "").encode("utf-16-le") for t in texts)]
    tables = [Counter(u[i : i + order] for u in padded for i in range(len(u) - order + 1))]
    for k in range(order - 1, 0, -1):
        tables.append(Counter(g[1:] for g in tables[-1]))
    p = {}
    for table in reversed(tables):
        c = Counter(table.values())
        cuts = [min(k - 0.05, max(0.05, k - (k + 1) * c[1] / (c[1] + 2 * c[2]) * c[k + 1] / c[k])) if c[k] and c[1] + 2 * c[2] else 0.5 for k in (1, 2, 3)]
        new = {}
        for g, n in table.items():
            near = {h: m for h, m in table.items() if h[:-1] == g[:-1]}
            rest = sum(cuts[min(m, 3) - 1] for m in near.values()) / sum(near.values())
            new[g] = (n - cuts[min(n, 3) - 1]) / sum(near.values()) + rest * (p[g[1:]] if p else 1 / len(near))
        p = new
    return [[float(np.log(p[u[i : i + order]])) for i in range(len(u) - order + 1)] for u in padded]


@pytest.mark.parametrize("slice_", [1 << 20, 800])
def test_quality(docs, none, monkeypatch, slice_):
    monkeypatch.setattr(quality_rules, "SLICE", slice_)
    got = quality_rules.quality(docs).collect()
    told = Counter((str(k), *base_counts(t)) for k, t, *_ in ROWS)
    assert Counter((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == told
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert not any(r["base_failed"] and r["kept"] for r in got)
    assert quality_rules.quality(none).count() == 0 and quality_rules.keep_good(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and Counter(map(str, (r["doc_id"] for r in kept.collect()))) == Counter(str(r["doc_id"]) for r in got if r["kept"])


def test_perplexity_by_brute_force(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choices(["aba", "bab", "ab", "cä", "d\U0001F600"], k=n)) for n in (30, 25, 40, 3)] + [None, ""]
    df = spark.createDataFrame([(i, t, "q" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(2)
    got = {r["doc_id"]: r for r in quality_rules.quality(df).collect()}
    for side in (0, 1):
        mine = [i for i in range(len(texts)) if i % 2 == side]
        for order, column in ((4, "perplexity"), (3, "perplexity_short")):
            for i, logs in zip(mine, kneser_ney([texts[i] for i in mine], order)):
                told = round(float(np.exp(-np.mean(logs))), 4) if logs else None
                assert got[i][column] == told or abs(got[i][column] - told) < 2e-4, (i, column)


def test_quality_rejects_planted_junk(spark):
    """Texts filled with symbols fall out of their language's own band, clean ones and a language of few texts stay."""
    rnd = random.Random(8)
    parts = "an er in on th re at en nd ti es or te of ed is it al ar st".split()
    clean = [" ".join("".join(rnd.choices(parts, k=rnd.randrange(1, 5))) for _ in range(rnd.randrange(400, 500))) for _ in range(120)]
    junk = [" ".join(w + "".join(rnd.choices("#$%&*|", k=2)) * (i % 3 == 0) for i, w in enumerate(c.split())) for c in clean[:4]]
    rows = [(i, c, "en") for i, c in enumerate(clean)] + [(1000 + i, c, "en") for i, c in enumerate(junk)] + [(2000, clean[5], "xx"), (2001, junk[0], "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.quality(df).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {k for k, r in got.items() if not r["kept"]} == set(range(1000, 1004)), {k: r['perplexity_short'] for k, r in got.items()}
    assert {r["doc_id"] for r in quality_rules.keep_good(df).collect()} == {k for k, r in got.items() if r["kept"]}


def test_kneser_ney_sums_to_one(spark):
    text = spark.createDataFrame([("abcabdabcabe" * 9,)], "t string")
    model = quality_rules.kneser_ney(quality_rules.gram_counts(text, "t", F.lit("x")))
    sums = model.groupBy(F.shiftrightunsigned("gram", 16)).agg(F.sum(F.exp("logp")).alias("s")).collect()
    assert all(0 < r["s"] <= 1.000001 for r in sums), sums


def test_mixing(docs, none):
    got = mixing.mix(docs, repeats=2.0).collect()
    assert {str(r["doc_id"]) for r in got} == {str(k) for k, *_ in ROWS}
    assert max(r["mix_epoch"] for r in got) <= 1 and all(0 <= r["mix_at"] < 1 for r in got)
    _, w = mixing.temperature({"a": 700, "b": 200, "c": 100}, repeats=2.0)
    assert abs(w["c"] / 0.1 / (w["a"] / 0.7) - 2) < 1e-6
    small = mixing.mix(docs, budget=500).groupBy("source").agg(F.sum("mix_tokens").alias("n"), F.first("mix_weight").alias("w")).collect()
    assert all(r["n"] <= 500 * r["w"] + 1e-6 for r in small if r["w"])
    assert mixing.mix(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    import public_tokenizers

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    told = Counter()
    for k, t, *_ in ROWS:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 100 + 1, len(ids) + 1, 100)]
        for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
            told[(k, j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = packing.pack(docs, capacity=100).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == told
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in held.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 100
    gaps, opened = [], 0  # sequential best-fit decreasing
    for n in sorted((r["length"] for r in got), reverse=True):
        at = bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else 100
        opened += gap == 100
        insort(gaps, gap - n)
    assert len(held) == opened
    assert packing.pack(none).count() == 0


def test_packing_added_tokens():
    """Ids of texts that hold added tokens literally equal those of `tokenizers` in its default setting."""
    from tokenizers import Tokenizer

    import public_tokenizers

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    for t in ("a <|endoftext|> b", end, end * 2, f"one two{end}three  four \n{end}", f" {end} ", "<|endoftext| >", f"<{end}|>", "plain words", "", "a\n b", "\nx y\n", "tab\there  two", "x\u00a0 y", "é\u2003z it's", "\t", " "):
        ids = np.frombuffer(packing.token_ids(t, *packing.default_tokenizer()), "<u4").tolist()
        assert ids == coder.encode(t, add_special_tokens=False).ids, t


def test_chat(spark):
    rows = [(c, t, r, x) for c in (1, None, 3) for t, r, x in ((0, "system", "be \\kind ### x"), (1, "user", "a </turn>\n b"), (2, "assistant", "w " * 300), (2, None, None), (3, "assistant", "\\### Assistant: </turn> ok"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2)
    order = lambda r: (r[1], r[2] or "", r[3] or "")
    for budget in (10, 200, 5000):
        got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df, budget=budget)).collect()}
        for c in (1, None, 3):
            mine = sorted((r for r in rows if r[0] == c), key=order)
            whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
            loss = "".join(r[3] for r in mine if r[2] == "assistant")
            assert (got[c]["turns_sha256"], got[c]["loss_chars"]) == (hashlib.sha256(whole.encode()).hexdigest(), len(loss))
            assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_chats(df.limit(0))).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://A.Org/x?y", '<a href="http://good.net/1">'), (2, "https://example.org/es/1", None), (3, "http://m.example.org/en/17", ""), (4, "http://bad.com/de/1", "<a href='//worse.net/'>"),
        (5, "http://worse.net/", '<a href="http://bad.com/de/1">'), (6, None, "x"), (7, "nothing", "x"), (8, "http://good.net", ""), (9, "http://notorg/", ""), (10, "http://x.com/fr/#z", ""),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2][2:] == ("example.org/es/", "block") and got[3][2:] == ("example.org/en/1", "block")
    assert got[4][2:] == ("com/de/", "block") and got[5] == ("worse.net", "/", None, "block") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("good.net", "", None, "allow") and got[9][2:] == (None, "allow") and got[10][2:] == ("com/fr/", "allow")


@pytest.mark.parametrize("page, told", [
    ('<article><p class="notice">x<p>real text</p><p>more</p></article>', "real text\nmore"),
    ('<article><h2 id="related-work">Related work</h2><p>a</p></article>', "Related work\na"),
    ('<article><p>See <a class="social-link">the paper</a> now.</p></article>', "See the paper now."),
    ('<article><div class="content-menu-free">kept</div><div class="cookie-notice">gone</div><div id="comments"><p>gone</p></div></article>', "kept"),
    ('<article><div class="ad">never closed<p>lost</article><p>after</p>', "after"),
    ('<article><ul><li class="promo">gone<li>kept</ul><p>a &lt;b&gt; &amp; c&nbsp;d</p><!-- x --><script>y</script></article>', "kept\na <b> & c d"),
    ('<body><nav>m</nav><main>one<br>two<form>f</form></main><footer>z</footer>', "one\ntwo"),
    ("<p>" + "long line " * 50_000 + "</p>", ("long line " * 50_000).strip()),
    ("plain", "plain"), ("", ""), ("<", "<"), ("<article></article><p>out</p>", "out"),
])
def test_html_blocks(page, told):
    assert "\n".join(html_text.blocks(page)[1]) == told


def test_html(spark):
    site = "<body><div><p>Site name</p><p>{}</p><p>Call us</p></div>"
    own = "Own text {} &amp; more words of page {}"
    rows = [(i, f"http://h/{i:02}", site.format(own.format(i, i)), "x") for i in range(40)]
    rows += [(100, None, "<nav>m</nav><article><h1>T</h1><p>a<b>b</b>\n c&nbsp;d<br>e</article><footer>f", "x"), (101, "u", None, None), (102, "u", "<p>x", "y")]
    rows += [(103, "http://same/1", "<p>copy</p>", "z")] * 2 + [(None, "http://lone/", "<p>lone</p>", "z")]
    # Columns that the operator has itself stand beside; results hang neither on partitions nor on chunks.
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumns({"host": F.lit(1), "rank": F.lit("r"), "chunk": F.lit("c")})
    for parts, chunk in ((1, 512), (7, 3), (3, 1)):
        got = {r["page_id"]: r["text"] for r in html_text.main_text(df.repartition(parts), chunk=chunk).collect()}
        assert [got[i] for i in range(40)] == [f"Own text {i} & more words of page {i}" for i in range(40)]
        assert (got[100], got[101], got[102], got[103], got[None]) == ("T\nab c d\ne", "", "x", "copy", "lone")
    assert html_text.main_text(df).count() == len(rows)
    none = html_text.main_text(df.limit(0))
    assert none.columns == ["page_id", "url", "text", "n_chars"] and none.count() == 0


def test_media(docs, none, spark, tmp_path):
    got = media_columns.media_columns(docs, path=f"file://{tmp_path}/m").collect()
    told = Counter()
    for k, t, *_ in ROWS:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        told[(k, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == told
    assert media_columns.media_columns(none).count() == 0


def test_media_retries_one_member(tmp_path):
    class Broken:
        calls = 0

        def read(self, info):
            Broken.calls += 1
            raise OSError("lost")

    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0/1", b"data")
    reader = media_columns.MediaReader({"path": f"file://{tmp_path}"})
    fs, _ = media_columns.pafs.FileSystem.from_uri(f"file://{tmp_path}")
    data, _ = reader.fetch(fs, Broken(), zipfile.ZipFile(tmp_path / "a.zip").infolist()[0], f"{tmp_path}/a.zip")
    assert data == b"data" and Broken.calls == 1


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, "")
        assert kept.columns == docs.columns and kept.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, kept, "").count() >= kept.count()


def test_bare_pages_over_many_partitions(spark):
    text = [" ".join(f"word{k * 31 + i}" for i in range(20)) for k in range(300)]
    rows = [(k, f"http://h{k % 3}.org/a/{k:04d}", f"<div>menu of h{k % 3}</div><p>{text[k]}</p><div>end of h{k % 3}</div>") for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 5, 600):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == dict(enumerate(text)), n


def test_links_that_framed_pages_share(spark):
    # Within an article no name tells the site's links: neighbours do. A licence line that they share stays.
    page = '<article><h1>Title {0}</h1><p>Text of page {0}, <a href="/x">with a link</a>, and more of it than what the site adds to it.</p><p>Free to copy.</p><p><a href="/top">Back to top</a></p><p><a href="/{0}">Own link {0}</a></p></article>'
    rows = [(i, f"http://h/{i:02}", page.format(i)) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), chunk=7).collect()}
    assert got == {i: f"Title {i}\nText of page {i}, with a link, and more of it than what the site adds to it.\nFree to copy.\nOwn link {i}" for i in range(30)}
