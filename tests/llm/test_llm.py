"""The ten operators against brute force, libraries and round trips, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import html
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from codequarry.llm import ann, audio, bpe, components, html_extract, ngram_join, packing, pii, quality, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, ids string, n_tokens string"
ODD = ["", None, "a", "  ", "x\n\n\ny  z", "naïve café 漢字 🙂🙂", "the the the", "'s 'll don't", "\t\r\n  x", "word " * 3000, "ab" * 5000, "<|endoftext|>"]


def docs(spark, texts, start=0):
    rows = [(start + k, t, "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def same_twice(spark, texts):
    """The texts, then one of them again under the same id, then one row without an id."""
    return docs(spark, texts).unionByName(docs(spark, texts[5:6], 5)).unionByName(spark.createDataFrame([(None, "lone text", None, None)], SCHEMA))


def texts_like(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    from codequarry.llm.vocabulary import ranks

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


class TestBpe:
    def test_like_the_library(self, spark, tik):
        coded = bpe.encode_texts(same_twice(spark, ODD + texts_like(1)), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
        texts = dict(enumerate(ODD + texts_like(1))) | {None: "lone text"}
        assert len(coded) == len(texts) + 1
        for r in coded:
            t = texts[r.doc_id] or ""
            assert np.frombuffer(r.ids, "<u4").tolist() == tik.encode_ordinary(t)
            assert bytes(r.decoded) == t.encode()

    def test_random_texts(self, tik):
        coder = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
        rng = random.Random(3)
        texts = ["".join(rng.choice("ab  \n\n\t '’sé漢1٣²_-.,🙂 \r") for _ in range(rng.randint(0, 16))) for _ in range(5000)]
        for t, ids in zip(texts, coder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(t)

    def test_appends_and_edits(self):
        coder = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
        rng = random.Random(4)
        for _ in range(200):
            piece = bytes(rng.choice(b"abcdefgh") for _ in range(30))
            table = coder.prefixes(piece)
            assert coder.prefixes(piece + b"ing", table, len(piece)) == coder.prefixes(piece + b"ing")
            edited = piece[:20] + b"zz" + piece[22:]
            assert coder.prefixes(edited, table, 20) == coder.prefixes(edited)

    def test_empty_table(self, spark):
        assert bpe.encode_texts(docs(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


class TestTokenCounts:
    def test_like_the_library(self, spark):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        path = P.path("piece_bpe_32k.model")
        ours = token_counts.unigram(path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        model.trainer_spec.model_type = 1
        for p in model.pieces:
            if p.type == 1:
                p.score = ours.score[p.piece] / 2**20
        library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        texts = ODD + texts_like(5)
        assert token_counts.count_tokens(docs(spark, []), path).count() == 0
        found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(same_twice(spark, texts), path).collect()}
        assert {k: len(library.encode(t or "")) for k, t in enumerate(texts)} | {None: len(library.encode("lone text"))} == found


class TestPacking:
    def test_cuts(self):
        for n in (1, 2, 2047, 2048, 2049, 10_000):
            cuts = packing.binary_cuts(n)
            assert sum(cuts) == n and all(c & (c - 1) == 0 and c <= 2048 for c in cuts)

    def test_sequences(self, spark):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
        texts = ODD + texts_like(6) + ["hello <|endoftext|> world<|startoftext|>", "<|ENDOFTEXT|> A", "Été H\u0331 A\u0301 I\u0307 ΣΑΣ ǅ Ⅷ ª a_b x²", "don't, can't. .., a. B,", "ÀB. ﬁ"]
        rows = packing.pack(same_twice(spark, texts).repartition(5), P.path("word_bpe_49k.json")).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
        for k, t in enumerate(texts):
            want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
            mine = sorted(by[k], key=lambda r: r.start)
            if k == 5:
                mine = mine[::2]
            assert [i for r in mine for i in np.frombuffer(r.ids, "<u4")] == want
            assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist() and all(r.doc_tokens == len(want) for r in mine)
        assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and all(r.offset == 0 for r in rows)
        lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
        assert lengths == sorted(lengths)


class TestAudio:
    def test_round_trip_and_features(self, spark):
        texts = ODD + texts_like(7, 10)
        df = same_twice(spark, texts)
        rows = audio.audio_columns(df.withColumn("payload", df.text.cast("binary"))).collect()
        by_text = {}
        for r in rows:
            raw = ((dict(enumerate(texts)) | {None: "lone text"})[r.doc_id] or "").encode()
            padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            assert bytes(r.payload) == padded and r.n_bytes == len(raw) and audio.samples(bytes(r.media))[1] == padded
            assert by_text.setdefault(raw, bytes(r.log_mel)) == bytes(r.log_mel)
            table = pa.ipc.open_stream(bytes(r.log_mel)).read_all()
            assert table.schema.field("log_mel").type.shape == [audio.WINDOW, audio.MELS]
            assert table.num_rows == -(-r.n_frames // audio.WINDOW)

    @pytest.mark.parametrize("up,down", [(1, 2), (3, 2), (2, 3), (1, 1)])
    def test_resampling(self, up, down):
        x = np.random.RandomState(0).randn(700).astype(np.float32)
        n = 16 * max(up, down) + 1
        t = np.arange(n) - n // 2
        h = np.sinc(t / max(up, down)) * np.hamming(n) / max(up, down) * up
        spread = np.zeros(len(x) * up)
        spread[::up] = x
        want = np.convolve(spread, h)[8 * max(up, down) :][: len(spread)][::down]
        assert np.allclose(audio.resample(x, up, down), want, atol=1e-5)

    def test_log_mel(self):
        """Frame by frame and filter by filter, with a plain Fourier sum."""
        x = np.random.RandomState(1).randn(1500).astype(np.float32) * 0.3
        mel, energy = audio.log_mel(x)
        hz = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * math.log10(1 + 4000 / 700), audio.MELS + 2)]
        assert len(mel) == len(energy) == 1 + math.ceil((1500 - audio.FRAME) / audio.HOP)
        for k in (0, 7, len(mel) - 1):
            frame = np.zeros(audio.FRAME)
            part = x[k * audio.HOP : k * audio.HOP + audio.FRAME]
            frame[: len(part)] = part
            assert abs(energy[k] - 10 * math.log10(sum(v * v for v in frame) / audio.FRAME + 1e-10)) < 1e-3
            shaped = [v * (0.5 - 0.5 * math.cos(2 * math.pi * j / (audio.FRAME - 1))) for j, v in enumerate(frame)]
            power = [abs(sum(v * np.exp(-2j * math.pi * b * j / audio.FFT) for j, v in enumerate(shaped))) ** 2 for b in range(audio.FFT // 2 + 1)]
            for m in range(audio.MELS):
                total = 0.0
                for b, p in enumerate(power):
                    f = b * audio.TARGET / audio.FFT
                    total += p * max(0.0, min((f - hz[m]) / (hz[m + 1] - hz[m]), (hz[m + 2] - f) / (hz[m + 2] - hz[m + 1])))
                assert abs(float(mel[k, m]) - math.log(total + 1e-6)) < 0.02

    def test_at_its_own_rate(self):
        """8 kHz needs no resampling: the features are those of the samples themselves."""
        payload = bytes(np.random.RandomState(2).randint(0, 256, 4000, dtype=np.uint8))
        x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
        mel, energy = audio.log_mel(audio.resample(x, 1, 1))
        got, n, found = audio.features(8000, payload)
        assert n == len(mel) and got == audio.tensors(mel) and len(found) == len(audio.segments(energy))

    def test_empty_table(self, spark):
        assert audio.audio_columns(docs(spark, []).withColumnRenamed("text", "payload")).count() == 0

    def test_hysteresis(self):
        energy = np.array([-30, -10, -15, -15, -17, -20, -10, -30, -16.0])
        assert audio.segments(energy) == [(1, 5)]


class TestHtml:
    def test_article(self):
        page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy it now.</div>
        <article><h1>A &amp; B</h1><p><b>First &lt;one&gt;<br><p>Second\n  one&nbsp;more.</p><section class="comments"><p>Nice post, the best of all!</p></section></article><aside>side</aside>
        <form>Name <input></form><footer>&copy; all</footer></body></html>"""
        assert html_extract.main_text(page) == "A & B\nFirst <one>\nSecond one more."

    def test_without_article(self):
        prose = "The cat is on the mat and it was there for all of us. " * 5
        page = f"<div id=top><a href=x>home</a> <a href=y>news</a></div><div><p>Short lead.</p><p>{prose}</p><p>The end.</p></div><div class=sidebar><p>{prose}</p></div>"
        assert html_extract.main_text(page) == f"Short lead.\n{prose.strip()}\nThe end."

    def test_odd_pages(self, spark):
        pages = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>unclosed &am", "x"), (None, "u", "<article><p>" + "a < b & c " * 5000, "x"), (5, "u", "<a <b <c 'x", "x")]
        rows = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
        assert rows[1].text == rows[2].text == "" and rows[2].n_chars == 0
        assert rows[None].text == " ".join(["a < b & c"] * 5000)

    def test_generated_pages(self, spark):
        undecided = 0
        for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
            inside = r.html[r.html.index("<article>") + 9 :].split("</article>")[0]
            parts = (" ".join(html.unescape(re.sub("<br>|</?b>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside))
            assert html_extract.main_text(r.html) == "\n".join(p for p in parts if p)
            undecided += html_extract.first_pass(html_extract.blocks(r.html))[0].count(0)
        assert undecided > 1000

    def test_second_pass(self):
        rng = random.Random(20)
        for _ in range(3000):
            n = rng.randint(0, 9)
            found = [html_extract.Block("x", 0.0, rng.random() < 0.5, rng.random() < 0.2) for _ in range(n)]
            labels = [-1 if b.outside else rng.choice([-1, 0, 0, 1]) for b in found]
            hint = rng.random() < 0.5
            at = [0]
            for x, y in zip(found, found[1:]):
                at.append(at[-1] + 1 + html_extract.CROSSING * ((hint and x.inside, x.outside) != (hint and y.inside, y.outside)))
            want = []
            for k, b in enumerate(found):
                near = {x: min([abs(at[k] - at[j]) for j in range(n) if labels[j] == x], default=10**6) for x in (1, -1)}
                if hint:
                    side = 1 if b.inside else -1
                    near[side] = min(near[side], html_extract.PRIOR)
                first = near[1] < near[-1] or (near[1] == near[-1] and (b.inside or not hint))
                want.append(labels[k] > 0 or (labels[k] == 0 and first))
            assert html_extract.second_pass(found, labels, hint) == (want if hint or any(labels) else [True] * n)

    @pytest.mark.parametrize("page,text", [
        ("<p>One two <button>Share this</button> More</p>", "One two More"),
        ('<p>Text <span class="share">Share on X</span> goes on.</p>', "Text goes on."),
        ('<article><p>text <span class="ad">x</p><p>more</p></article>', "text\nmore"),
        ("<p>a <script>x</script>b <textarea>q</textarea>c</p>", "a b c"),
        ("<article><ul><li>one<li>two</ul></article>", "one\ntwo"),
        ("<article><pre>x = 1</pre></article>", "x = 1"),
        ('<article><div class="related-work"><p>Others did it.</p></div><div class="related-posts"><p>Read on</p></div></article>', "Others did it."),
        ("<p>a <![CDATA[ y > z ]]> b</p>", "a b"),
        ("<div>Cookies!</div><article><h1>Title</h1><p>Body.</p></article><div>Bye.</div>", "Title\nBody."),
        ("", ""),
    ])
    def test_faults(self, page, text):
        assert html_extract.main_text(page) == text

    def test_empty_table(self, spark):
        assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0

    def test_article_is_a_hint(self):
        prose = "The cat is on the mat and it was there for all of us. " * 5
        cards = "".join(f"<article><h3>Card {k}</h3><p>Read on.</p></article>" for k in range(3))
        assert prose.strip() in html_extract.main_text(f"<div><p>{prose}</p><p>{prose}</p></div>{cards}")
        both = html_extract.main_text(f"<article><p>{prose}</p><p>Yes.</p></article><div>{prose}</div><div>Short.</div><div>{'Zrk vlad ' * 40}</div>")
        assert both == f"{prose.strip()}\nYes.\n{prose.strip()}"

    def test_self_closed(self):
        for tag in ("<svg/>", '<svg viewBox="0 0 1=1"/>', "<svg hidden />", "<math/>"):
            assert html_extract.main_text(f"<article><p>One two.</p>{tag}<p>Three.</p></article>") == "One two.\nThree.", tag
        for tag in ("<svg a=b/>x</svg>", "<svg a= b/>x</svg>", "<svg>x</svg>", "<script src=a />x</script>"):
            assert html_extract.main_text(f"<article><p>One two.</p>{tag}<p>Three.</p></article>") == "One two.\nThree.", tag

    def test_without_the_article_tag(self, spark):
        long = lambda text: [x for x in text.split("\n") if len(x) >= html_extract.LONG]
        had = left = 0
        for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
            had += sum(map(len, long(html_extract.main_text(r.html))))
            left += sum(map(len, long(html_extract.main_text(r.html.replace("article>", "div>")))))
        assert left >= 0.9 * had > 0


class TestPii:
    EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
    PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(self, t):
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        found = [(m.start(), 0, m.end()) for m in self.EMAIL.finditer(t)]
        found += [(m.start(), 1, m.end()) for m in self.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        found += [(m.start(), 2, m.end()) for m in self.CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits(m)[::-1])) % 10 == 0]
        found += [(m.start(), 3, m.end()) for m in self.PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
        return sorted(found)

    def test_base_spans(self):
        rng = random.Random(8)
        for alphabet, n in (("a@.b-1 +2(9)3", 30), ("0123456789 -", 60), ("+1 (2)3-4.5", 40)):
            for _ in range(20_000):
                t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
                assert pii.base_spans(t) == self.brute(t), t

    def test_long_texts_take_linear_time(self):
        for t in ("1" * 300_000, "a" * 300_000, "a" * 200_000 + "@", "1.1." * 80_000, "+1" * 100_000, "@" * 200_000):
            pii.base_spans(t)

    def test_terms(self, spark):
        rng = random.Random(9)
        fill = lambda: " ".join(rng.choice(["red", "green", "blue", "grey"]) for _ in range(12))
        texts = [fill() for _ in range(200)] + [f"{fill()} zorblat bob@ex.com {fill()}" for _ in range(6)] + ["", None, "x@y.zz alone"]
        rows = {r.doc_id: r for r in pii.find(same_twice(spark, texts)).collect()}
        for k in range(200, 206):
            kinds = [(texts[k][s.start : s.end], s.kind) for s in rows[k].spans]
            assert ("bob@ex.com", 0) in kinds and ("zorblat", 4) in kinds and not any(w in ("red", "green") for w, _ in kinds)
        assert rows[206].spans == [] and rows[207].spans == [] and len(rows[208].spans) == 1
        clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
        assert "bob@ex.com" not in clean[200] and "zorblat" not in clean[200] and "[EMAIL]" in clean[200] and clean[0] == texts[0] and clean[207] is None
        assert pii.find(docs(spark, [])).count() == 0

    def test_terms_against_brute_force(self, spark):
        rng = random.Random(21)
        words = ["red", "green", "blue", "grey", "white"]
        texts = []
        for k in range(600):
            t = [rng.choice(words) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.3:
                n = rng.randint(0, 9)
                t[rng.randint(0, len(t)) : 0] = [rng.choice([f"name{n}", f"Name{n}", f"boss{n % 3}"]), f"u{n}@ex.com" if rng.random() < 0.9 else f"10.0.0.{n}", rng.choice([f"Desk{n}", "blue", f"tel{n}"])]
            texts.append(" ".join(t))
        token = re.compile(r"\w+")
        total, n_t, n_e, n_te = 0, collections.Counter(), collections.Counter(), collections.Counter()
        of_doc = []
        for t in texts:
            spans = self.brute(t)
            every = [(m.start(), m.end(), m[0].lower()) for m in token.finditer(t)]
            total += len(every)
            n_t.update(w for *_, w in every)
            outside = [w for w in every if all(w[1] <= a or w[0] >= b for a, _, b in spans)]
            near = set()
            for a, kind, b in spans:
                entity = (kind, t[a:b].lower())
                left, right = [w for w in outside if w[1] <= a][-pii.REACH :], [w for w in outside if w[0] >= b][: pii.REACH]
                near |= {(entity, w) for w in left + right}
            n_e.update(e for e, _ in near)
            n_te.update((w[2], e) for e, w in near)
            of_doc.append((spans, outside, {e for e, _ in near}))
        telling = set()
        for (w, e), hits in n_te.items():
            draws, chance = n_t[w], (n_e[e] / total) ** (1 - pii.SHARE)
            missed = draws - hits
            surprise = hits * math.log(hits / (draws * chance)) + (missed * math.log(missed / (draws * (1 - chance))) if missed else 0)
            if hits >= draws * chance and surprise > -math.log(1 - pii.SURE):
                telling.add((w, e))
        assert len(telling) > 10
        got = {r.doc_id: sorted((s.start, s.kind, s.end) for s in r.spans) for r in pii.find(docs(spark, texts)).collect()}
        for k, (spans, outside, held) in enumerate(of_doc):
            terms = [(a, pii.KINDS.index("term"), b) for a, b, w in outside if any((w, e) in telling for e in held)]
            assert got[k] == sorted(spans + terms), texts[k]

    def test_odd_rows(self, spark):
        df = same_twice(spark, ["a@b.cc x", None, "", "1.2.3.4", "q", "w", "9"]).unionByName(spark.createDataFrame([(None, "a@b.cc z", None, None)], SCHEMA))
        found = pii.find(df).collect()
        assert len(found) == df.count() and sum(r.doc_id is None for r in found) == 2
        clean = pii.sanitise(df)
        assert clean.columns == df.columns and sorted(str(r.text) for r in clean.collect()) == sorted(["[EMAIL] x", "None", "", "[IP]", "q", "w", "w", "9", "lone text", "[EMAIL] z"])
        assert pii.sanitise(docs(spark, [])).count() == 0

    def test_terms_of_one_signature(self, spark):
        rng = random.Random(10)
        fill = lambda n: " ".join(rng.choice(["red", "green", "blue", "grey"]) for _ in range(n))
        signed = [f"{fill(20)} Greetings from your old friend Zorblat of red bob@ex.com" for _ in range(4)]
        texts = [fill(40) for _ in range(400)] + signed + [f"{fill(12)} once lone@ex.com {fill(12)}"]
        rows = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
        for k in range(400, 404):
            assert {texts[k][s.start : s.end] for s in rows[k].spans if s.kind == 4} == {"Greetings", "from", "your", "old", "friend", "Zorblat", "of"}
        assert [s.kind for s in rows[404].spans] == [0]

    def test_terms_far_from_the_value(self, spark):
        rng = random.Random(11)
        fill = lambda n: " ".join(rng.choice(["red", "green", "blue", "grey"]) for _ in range(n))
        letters = [f"Zorblat {fill(30)} zorblat bob@ex.com {fill(30)} ZORBLAT." for _ in range(2)]
        texts = [fill(40) for _ in range(400)] + letters + [f"{fill(20)} zorblat bob@ex.com {fill(20)}" for _ in range(60)] + ["zorblat alone"]
        df = docs(spark, texts).unionByName(spark.createDataFrame([(None, letters[0], None, None)], SCHEMA))
        rows = {r.doc_id: r for r in pii.find(df).collect()}
        for k in (400, 401, None):
            text = letters[0] if k is None else texts[k]
            assert [text[s.start : s.end] for s in rows[k].spans] == ["Zorblat", "zorblat", "bob@ex.com", "ZORBLAT"]
        assert rows[462].spans == []
        assert {r.text for r in pii.sanitise(df).collect() if "[EMAIL]" in r.text and "zorblat" in r.text.lower()} == set()


def brute_join(rows, t=0.8, n=5):
    sets = []
    for _, x in rows:
        w = (x or "").split()
        k = min(n, len(w))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    parent, links = list(range(len(sets))), [0] * len(sets)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            m = len(sets[a] & sets[b])
            if m and 5 * m >= 4 * (len(sets[a]) + len(sets[b]) - m):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    ids = collections.defaultdict(list)
    for a in range(len(sets)):
        ids[root(a)].append(rows[a][0])
    least = lambda v: min((i for i in v if i is not None), default=None)
    return sorted(((rows[a][0], least(ids[root(a)]), links[a]) for a in range(len(sets))), key=str)


class TestNgramJoin:
    def texts(self):
        rng = random.Random(10)
        base = texts_like(11, 15)
        out = []
        for t in base:
            w = t.split()
            for _ in range(rng.randint(1, 6)):
                v = list(w)
                for _ in range(rng.randint(0, 3)):
                    if v:
                        v[rng.randrange(len(v))] = "other"
                out.append(" ".join(v))
        return out + ["", None, "  ", "one two", "one two", "one  two", "solo"]

    @pytest.mark.parametrize("block", [400_000, 150])
    def test_brute_force(self, spark, block):
        texts = self.texts()
        df = same_twice(spark, texts)
        rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, "lone text")]
        got = sorted((tuple(r)[:3] for r in ngram_join.join(df, block=block).collect()), key=str)
        assert got == brute_join(rows)

    def test_one_of_each(self, spark):
        texts = self.texts()
        df = same_twice(spark, texts)
        stays = ngram_join.one_of_each(df)
        assert stays.columns == df.columns
        classes = {r[0]: r[1] for r in ngram_join.join(docs(spark, texts)).collect()}
        ids = [r.doc_id for r in stays.collect()]
        assert sorted(i for i in ids if i is not None) == sorted(k for k, c in classes.items() if k == c) and ids.count(None) == 1

    def test_prefixes(self, spark):
        rng = np.random.default_rng(16)
        least = ngram_join.shortest()
        assert 1 - (1 - 0.8**least) ** ngram_join.TREES >= ngram_join.RECALL > 1 - (1 - 0.8 ** (least + 1)) ** ngram_join.TREES
        head, tail = ngram_join.signatures(np.arange(50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 32, 8)
        assert len(set(head.tolist())) == 32 and head.dtype == np.int64
        # Few different hashes, so that prefixes of all lengths are shared.
        values = rng.integers(0, 3, (200, 3, 8)).astype(">u2")
        packed = values.view(">u8").astype(np.uint64).view(np.int64)
        rows = [(bytes([k]), 1, 1, 40, packed[k, :, 0].tolist(), packed[k, :, 1].tolist()) for k in range(200)]
        nodes = spark.createDataFrame(rows, "node binary, doc long, copies long, n_grams long, heads array<long>, tails array<long>").repartition(4)
        a, b = values[:, None], values[None, :]
        common = np.cumprod(a == b, axis=3).sum(3)
        for k in range(200):
            common[k, k] = 0
        for recall in (0.9, 0.99):
            least = ngram_join.shortest(0.95, 3, 8, recall)
            longest = common.max(1)
            pairs = set()
            for x in range(200):
                d = 8
                while d > least and math.prod(1 - 0.95 ** max(least, min(d, m)) for m in longest[x]) > 1 - recall:
                    d -= 1
                pairs |= {frozenset((x, y)) for y in range(200) if y != x and any(common[x, y, t] >= min(d, longest[x, t]) >= least for t in range(3))}
            parent = list(range(200))

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for x, y in map(sorted, pairs):
                parent[max(root(x), root(y))] = min(root(x), root(y))
            found = {r.node[0]: r.root[0] for r in components.components(ngram_join._forest(nodes, 0.95, 3, 8, recall)).collect()}
            whole = {k for p in pairs for k in p}
            # Rows at a task's border may add candidates, and none may be missing.
            assert whole <= set(found) and all(found[x] == found[y] for x, y in map(sorted, pairs))
            assert len(set(found.values())) >= 0.5 * len({root(x) for x in whole})

    def test_components(self, spark):
        edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(1000, 1000 + k) for k in range(1, 300)]
        found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100} | {1000 + k: 1000 for k in range(300)}
        assert ngram_join.join(docs(spark, [])).count() == 0

    def test_recall(self, spark):
        """Pairs just above the threshold are found: 300 of them, each alone."""
        rng = random.Random(17)
        texts = []
        for k in range(300):
            w = [f"w{k}_{j}" for j in range(rng.randint(60, 120))]
            for n in range(len(w), 0, -1):
                if 5 * (n - 4) >= 4 * (len(w) - 4):
                    least = n
            texts += [" ".join(w), " ".join(w[:least])]
        rows = ngram_join.join(docs(spark, texts)).collect()
        assert [(r.doc_id // 2 * 2, 1) for r in rows] == [(r.class_id, r.n_links) for r in rows]


def brute_dedup(rows, length):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        out.append((doc, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def dedup_here(rows, length, gram, batch=7):
    """The rounds of suffix_dedup without Spark, so that its parts can be exchanged: (doc, n_removed) of each row."""
    D = suffix_dedup
    made = pa.table({"raw": [t.encode() for _, t in rows], "doc": pa.array([d for d, _ in rows], pa.int64()), "tie": pa.array([0] * len(rows), pa.int64())})

    def ranked(batches):
        table = pa.Table.from_batches(list(batches)).sort_by([(c, "ascending") for c in ("q", "o1", "o2", "doc", "tie", "pos")])
        out = list(D.classify(iter(table.to_batches(max_chunksize=batch))))
        return pa.Table.from_batches(out, schema=table.schema).to_pylist()

    found = ranked(D.find_samples(iter(made.to_batches(max_chunksize=3)), length, gram))
    marks = [(r["doc"], r["pos"] - (length - gram), r["pos"] + length) for r in found if r["kind"] == D.REPEAT]
    laid = made
    for name, kind in (("wanted", D.OPEN), ("repeated", D.REPEAT)):
        laid = laid.append_column(name, pa.array([[r["pos"] for r in found if r["doc"] == d and r["kind"] == kind] for d, _ in rows], pa.list_(pa.int32())))
    cells, width = D.open_cells(iter(laid.to_batches(max_chunksize=5)), length, gram), length - gram + 1
    while width > 1:
        width = -(-width // D.PARTS)
        batches = list(D.cut(cells, length))
        found = ranked(batches) if batches else []
        marks += [(r["doc"], r["pos"] - r["last"], r["pos"] - r["first"] + length) for r in found if r["kind"] == D.REPEAT]
        cells = iter([tuple(r[c] for c in ("doc", "tie", "pos", "first", "last", "low", "high", "around", "before")) for r in found if r["kind"] == D.OPEN])
    gone = {d: bytearray(len(t.encode())) for d, t in rows}
    for d, a, e in marks:
        for k in range(max(a, 0), min(e, len(gone[d]))):
            gone[d][k] = 1
    return {d: sum(g) for d, g in gone.items()}


def dedup_texts(rng, alphabet, n=60):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(10)]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randint(0, 200)
            t += b[a : a + rng.randint(0, 200)]
        texts.append("ab" * rng.randint(0, 150) if rng.random() < 0.2 else t)
    return texts


class TestSuffixDedup:
    @pytest.mark.parametrize("alphabet,length,gram", [("ab", 100, 32), ("abé \n", 100, 32), ("abé \n", 40, 16)])
    def test_brute_force(self, spark, alphabet, length, gram):
        texts = dedup_texts(random.Random(12), alphabet) + [None, "", "x" * 5000]
        df = same_twice(spark, texts).unionByName(spark.createDataFrame([(None, texts[7], "", "")], SCHEMA)).repartition(3)
        rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, "lone text"), (None, texts[7])]
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.dedup(df, length=length, gram=gram).collect()), key=str)
        assert got == brute_dedup(rows, length)

    @pytest.mark.parametrize("kind", ["as it is", "names collide", "short chunks"])
    def test_rounds(self, monkeypatch, kind):
        names = suffix_dedup.names
        if kind == "names collide":
            monkeypatch.setattr(suffix_dedup, "names", lambda raw, gram: names(raw, gram) % np.uint64(5))
            monkeypatch.setattr(suffix_dedup, "core_name", lambda raw: raw[0] % 3)
        if kind == "short chunks":
            monkeypatch.setattr(suffix_dedup, "CHUNK", 130)
            monkeypatch.setattr(suffix_dedup, "CELLS", 9)
        for seed in range(12):
            length, gram = [(100, 32), (40, 16), (20, 4)][seed % 3]
            rows = list(enumerate(dedup_texts(random.Random(seed), ["ab", "abcdé \n", "xyz"][seed // 3 % 3], 25) + ["ab" * 400]))
            assert dedup_here(rows, length, gram) == {d: n for d, _, n, _, _ in brute_dedup(rows, length)}

    def test_batches_change_nothing(self):
        D, rng = suffix_dedup, random.Random(31)
        for _ in range(200):
            rows = sorted((q, o := rng.randint(0, 1), o, doc, 0, 0, D.RANK) for doc, q in enumerate(rng.choices(range(4), k=12)))
            table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), D._SAMPLES)], schema=D._SAMPLES)

            def told(size):
                return sorted((r["doc"], r["kind"]) for b in D.classify(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist())

            assert all(told(size) == told(12) for size in range(1, 12)), rows

    def test_cells_of_one_offset_are_not_cut(self):
        """The first cell's copy begins a batch that ends within another group: before, the first then went on, without bytes to cut."""
        D, text = suffix_dedup, bytes(range(102))
        rows = [(1, 1, 1, doc, 0, 68, D.RANK, 68, 68, 68, 68, None, 68) for doc in range(2)] + [(2, 2, k, 2 + k, 0, 9, D.RANK, 0, 2, 0, 2, text, 2) for k in range(3)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), D._CELLS)], schema=D._CELLS) for part in (rows[:1], rows[1:4], rows[4:])]
        found = [r for b in D.classify(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["doc"], r["kind"]) for r in found) == [(1, D.REPEAT), (2, D.OPEN), (3, D.OPEN), (4, D.OPEN)]
        cells = [tuple(r[c] for c in ("doc", "tie", "pos", "first", "last", "low", "high", "around", "before")) for r in found if r["kind"] == D.OPEN]
        assert sum(b.num_rows for b in D.cut(iter(cells), 100)) == 9

    def test_empty_table(self, spark):
        assert suffix_dedup.dedup(docs(spark, [])).count() == 0 and suffix_dedup.cleaned(docs(spark, [])).count() == 0

    def test_cleaned_keeps_rows_and_columns(self, spark):
        passage = "é" * 10 + " ".join(texts_like(13, 3)[0].split()[:40])
        df = docs(spark, [passage + " one", "two " + passage, None, ""])
        rows = {r.doc_id: r for r in suffix_dedup.cleaned(df).collect()}
        assert suffix_dedup.cleaned(df).columns == df.columns and len(rows) == 4
        assert rows[0].text == passage + " one" and rows[1].text.startswith("two") and passage not in rows[1].text and rows[2].text is None and rows[0].ids == "clash"


class TestQuality:
    def test_held_out_labels(self, spark):
        documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        model = quality.fit(documents)
        found = quality.score(documents, model).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
        good, bad = [r.keep for r in found if r.quality == 1], [r.keep for r in found if r.quality == 0]
        assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1
        odd = {r.doc_id: r for r in quality.score(same_twice(spark, ODD), model).collect()}
        assert len(odd) == len(ODD) + 1 and not odd[0].keep and not odd[1].keep
        stays = quality.kept(same_twice(spark, ODD), model)
        assert {r.doc_id for r in stays.collect()} == {k for k, r in odd.items() if r.keep} and stays.columns == SCHEMA.replace("long", "").replace("string", "").replace(" ", "").split(",")

    def test_em_finds_accuracies(self):
        rng = random.Random(14)
        counts = collections.Counter()
        for _ in range(20_000):
            bad = rng.random() < 0.2
            counts[tuple(0 if rng.random() < 0.1 else (-1 if rng.random() < (f if bad else g) else 1) for f, g in ((0.9, 0.02), (0.7, 0.01), (0.5, 0.1), (0.8, 0.05)))] += 1
        posterior, labellers = quality.expectation_maximisation(counts)
        for x, (f, g) in zip(labellers, ((0.9, 0.02), (0.7, 0.01), (0.5, 0.1), (0.8, 0.05))):
            assert abs(x["finds"] - f) < 0.06 and abs(1 - x["spares"] - g) < 0.02
        assert posterior[-1, -1, -1, -1] < 0.01 and posterior[1, 1, 1, 1] > 0.9
        # One labeller that errs often does not make a text bad; a surer one against it does not either.
        assert posterior[1, 1, -1, 1] > 0.9 and posterior[-1, -1, 1, 1] < 0.5
        assert quality.expectation_maximisation({})[0] == {}

    def test_em_text_by_text(self):
        rng = random.Random(18)
        texts = [tuple(rng.choice([-1, 0, 1, 1, 1]) for _ in range(3)) for _ in range(80)]
        finds, spares, prior = [quality.START[0]] * 3, [quality.START[1]] * 3, 0.8
        for _ in range(quality.ROUNDS):
            q = []
            for t in texts:
                good, bad = prior, 1 - prior
                for k, x in enumerate(t):
                    good *= 1 if not x else spares[k] if x > 0 else 1 - spares[k]
                    bad *= 1 if not x else 1 - finds[k] if x > 0 else finds[k]
                q.append(good / (good + bad))
            voted = [(t, x) for t, x in zip(texts, q) if any(t)]
            for k in range(3):
                finds[k] = (sum(1 - x for t, x in voted if t[k] < 0) + 1) / (sum(1 - x for t, x in voted if t[k]) + 2)
                spares[k] = (sum(x for t, x in voted if t[k] > 0) + 1) / (sum(x for t, x in voted if t[k]) + 2)
            prior = (sum(x for _, x in voted) + 1) / (len(voted) + 2)
        posterior, found = quality.expectation_maximisation(collections.Counter(texts))
        assert np.allclose([x["finds"] for x in found], finds) and np.allclose([x["spares"] for x in found], spares)
        assert np.allclose([posterior[t] for t, _ in voted], [x for _, x in voted])

    def test_labellers_differ(self, spark):
        """No two labellers vote alike, each votes bad somewhere, and their weights decide: not every bad vote makes a text bad."""
        texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
        patterns = [quality.pattern(t) for t in texts]
        bad = [frozenset(k for k, p in enumerate(patterns) if p[j] < 0) for j in range(len(quality.LABELLERS))]
        assert all(bad) and len(set(bad)) == len(bad)
        posterior, found = quality.expectation_maximisation(collections.Counter(patterns))
        any_bad = [p for p in patterns if min(p) < 0]
        assert 0.05 * len(any_bad) < sum(posterior[p] >= 0.5 for p in any_bad) < 0.5 * len(any_bad)
        assert max(x["spares"] for x in found) - min(x["spares"] for x in found) > 0.01

    def test_empty_table(self, spark):
        assert quality.score(docs(spark, []), quality.fit(docs(spark, []))).count() == 0


class TestNearest:
    def brute(self, vectors, k):
        ids = np.array(sorted(vectors))
        x = np.array([vectors[i] for i in ids])
        out = {}
        for q in ids[ids % 20 == 0]:
            s = (x * vectors[q]).sum(1)
            s[ids == q] = -np.inf
            order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
            out[int(q)] = [(int(ids[i]), float(s[i])) for i in order]
        return out

    def test_recall_ties_and_odd_rows(self, spark):
        rng = np.random.default_rng(15)
        vectors = {k: rng.standard_normal(16) for k in range(600)}
        for k in range(300, 420):
            vectors[k] = vectors[20]
        rows = [(k, v.tolist(), "clash") for k, v in vectors.items()]
        odd = [(1001, None, ""), (1002, [0.0] * 16, ""), (1003, [float("nan")] * 16, ""), (1004, [1.0, None] + [0.0] * 14, ""), (None, [1.0] * 16, ""), (1005, [float("inf")] + [0.0] * 15, ""), (1006, [1.0] * 3, "")]
        df = spark.createDataFrame(rows + rows[:3] + odd, "vec_id long, embedding array<double>, score string")
        indexed, books = ann.index(df, books=8)
        assert indexed.count() == 600
        found = collections.defaultdict(list)
        for r in ann.search(indexed, books, indexed.filter("id % 20 = 0"), block=200 * 16 * 8, reranked=256).orderBy("query_id", "rank").collect():
            found[r.query_id].append((r.id, r.score))
        want = self.brute(vectors, 20)
        assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
        hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits / sum(map(len, want.values())) > 0.95
        assert [i for i, _ in found[20]] == list(range(300, 320))  # ties to smaller ids

    @pytest.mark.parametrize("clusters", [0, 50])
    def test_recall_with_the_querys_parameters(self, spark, clusters):
        rng = np.random.default_rng(19)
        x = rng.standard_normal((16_000, 64))
        if clusters:
            x = 0.3 * x + rng.standard_normal((clusters, 64))[rng.integers(0, clusters, len(x))]
        df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
        indexed, books = ann.index(df)
        found = collections.defaultdict(set)
        for r in ann.search(indexed, books, indexed.filter("id % 20 = 0"), block=4_000 * 64 * 8).collect():
            found[r.query_id].add(r.id)
        hits = 0
        for q in range(0, len(x), 20):
            s = x @ x[q]
            s[q] = -np.inf
            hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
        assert hits / len(x) >= 0.95

    def test_few_and_none(self, spark):
        few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
        indexed, books = ann.index(few)
        rows = ann.search(indexed, books, indexed.filter("id = 0")).collect()
        assert [(r.rank, r.id, r.score) for r in sorted(rows, key=lambda r: r.rank)] == [(1, 1, 0.5), (2, 2, 0.0)]
        indexed, books = ann.index(few.filter("vec_id < 0"))
        assert ann.search(indexed, books, indexed).count() == 0


class TestQueries:
    D = "/root/testdata/sf0.001"

    def test_columns_of_the_contracts(self, spark):
        from codequarry.llm.queries import QUERIES

        n = spark.read.parquet(f"{self.D}/documents.parquet").count()
        want = {
            "op1_html_extract": "page_id url text n_chars", "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op4_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
            "op6_audio_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op8_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
            "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op10_nearest": "query_id rank vec_id score",
        }
        for name, columns in want.items():
            df = QUERIES[name](spark, self.D)
            assert df.columns[: len(columns.split())] == columns.split(), name
            rows = df.collect()
            assert len(rows) == n if name[:3] in ("op3", "op4", "op6", "op8") else rows, name

    def test_sql(self, spark):
        import glob
        import os

        import duckdb

        from codequarry.llm.queries import ORACLE_SQL, QUERIES

        con = duckdb.connect()
        for p in glob.glob(f"{self.D}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        assert {"op5_ngram_join", "op8_suffix_dedup"} <= set(ORACLE_SQL)
        for name, sql in ORACLE_SQL.items():
            df, want = QUERIES[name](spark, self.D), con.execute(sql)
            names = [c[0] for c in want.description]
            assert sorted(names) == sorted(df.columns), name
            assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(want.fetchall()), name

    def test_digests(self, spark):
        from codequarry.llm.queries import QUERIES

        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{self.D}/documents.parquet").collect()}
        for r in QUERIES["op6_audio_columns"](spark, self.D).collect():
            raw = texts[r.doc_id].encode()
            padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            assert (r.payload_sha256, r.tail_crc32, r.media_sha256) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), hashlib.sha256(audio.wav(padded)).hexdigest())
        spans = TestPii()
        for r in QUERIES["op3_pii"](spark, self.D).collect():
            base = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans.brute(texts[r.doc_id])]
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(","))
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
        for r in QUERIES["op9_packing"](spark, self.D).collect():
            ids = np.array(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes() + struct.pack("<I", 1)
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])

    def test_pipeline(self, spark):
        import corpus_pipeline

        documents = spark.read.parquet(f"{self.D}/documents.parquet")
        df = documents
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, df, self.D)
            assert after.columns == documents.columns, name
            df = after
        ids = {r.doc_id for r in df.collect()}
        rows = corpus_pipeline.run(spark, self.D).collect()
        assert {r.doc_id for r in rows} == ids and 0.6 * documents.count() < len(ids) < documents.count()

    def test_stages_with_odd_rows(self, spark):
        """Nulls, empty texts, repeated rows, clashing names and empty tables: each stage keeps the columns, and what it must do is done."""
        import corpus_pipeline

        stages = dict(corpus_pipeline.STAGES)
        schema = "doc_id long, text string, lang string, source string, n_chars long, id string, spans string, rest0 string"
        prose = texts_like(22, 30)
        rows = [(k, t, "en", "s", len(t), "a", "b", "c") for k, t in enumerate(prose)]
        rows += [rows[3], (None, prose[4], "en", None, None, None, None, None), (None, None, None, None, None, None, None, None), (90, None, "en", "s", 0, "", "", ""), (91, "", "en", "s", 0, "", "", ""), (92, f"{prose[5]} me@ex.com", "en", "s", 5, "", "", "")]
        df, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
        for name, stage in list(stages.items())[:-1]:
            assert stage(spark, empty, self.D).count() == 0, name
            got = stage(spark, df, self.D)
            assert [f.dataType for f in got.schema] == [f.dataType for f in df.schema] and got.columns == df.columns, name
        assert list(stages.values())[-1](spark, empty, self.D).count() == 0
        kept = collections.Counter((r.doc_id, r.text) for r in stages["n-gram Jaccard join"](spark, df, self.D).collect())
        assert kept[3, prose[3]] == 1 and kept[None, prose[4]] == 0 and kept[None, None] == 1 and kept[91, ""] == 1
        after = stages["suffix-array dedup"](spark, df, self.D).collect()
        assert len(after) == len(rows) and sorted(len(r.text or "") for r in after if r.doc_id == 3)[0] < 100 <= len(prose[3])
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        assert [r.text for r in stages["PII"](spark, df, self.D).collect() if r.doc_id == 92][0].endswith("[EMAIL]")
        assert sum(r.length for r in list(stages.values())[-1](spark, df, self.D).collect() if r.doc_id in (90, 91)) == 2
