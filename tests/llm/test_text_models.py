import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import lm, merge_dropout, quality
from pairwright.llm import words as words_module
from pairwright.llm.lm import score_documents
from pairwright.llm.merge_dropout import Pieces, decode_pieces, encode_pieces
from pairwright.llm.packing_fit import pack_texts, plan_packing
from pairwright.llm.quality import classify, fit_sample, held_out, keep_good
from pairwright.llm.queries import WORD_BPE_EDGES, op4_quality_classifier, tokenizer_file
from pairwright.llm.words import WordIds

WORDS, PIECES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_word_ids_are_the_tokenizers_own(corpus, tokenizer):
    texts = [t or "" for _, t, _ in corpus] + ["İstanbul ΣΑΣ straße, ﬁn… a.b it's don'T 12.5% x²Ⅷ \u00a0y e\u0301 \u2028z", "!!! ?.,;:"]
    got = WordIds(WORDS).encode([t.encode() for t in texts])
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_met_once_are_not_remembered(tokenizer):
    words = WordIds(WORDS)
    once = [f"w{number}x rare{chr(97 + number % 26)}{'e' * (number // 26)}" for number in range(2000)]
    texts = [f"{text} the, cat" for text in once]
    for _ in range(2):
        for text, ids in zip(texts, words.encode([t.encode() for t in texts])):
            assert np.frombuffer(ids, np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert set(words.known) == {b"the,", b"cat"}
    # Letters that normalization changes, and bytes that are no UTF-8.
    odd = ["\u212a\u212b \u1e9e.. \u1100\u1161 \ufb01n\u0178!", " \x0b a\x1cb \t"]
    for text, ids in zip(odd, words.encode([t.encode() for t in odd])):
        assert np.frombuffer(ids, np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert words.encode([b"a\xff b"]) == words.encode(["a\ufffd b".encode()])


def test_letters_of_known_words_are_not_worked_out_again(tokenizer):
    words = WordIds(WORDS)
    words.encode([b"cat bird cat bird"])
    asked, bare = [], words.bare

    class Bare:
        def encode_batch_fast(self, lines, add_special_tokens):
            asked.extend(word for line in lines for word in line.split())
            return bare.encode_batch_fast(lines, add_special_tokens=add_special_tokens)

    words.bare = Bare()
    texts = ["cat, Cat. CAT!? bird; dog", "", "dog! dog DOG: cat", "\u00d7cat \u00c9t\u00e9. cat's"]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == ["dog", "\u00e9t\u00e9"]


def test_a_full_memory_keeps_the_words_of_most_calls(monkeypatch, tokenizer):
    monkeypatch.setattr(words_module, "REMEMBERED", 6)
    monkeypatch.setattr(words_module, "CARRIED", 2)
    words = WordIds(WORDS)
    for turn in range(12):
        texts = [f"the the cat, cat, n{turn} n{turn} {'x' * turn} \xa0{'y' * turn}y \xa0{'y' * turn}y"]
        for text, ids in zip(texts, words.encode([t.encode() for t in texts])):
            assert np.frombuffer(ids, np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(words.known) <= 10
    words.forget()
    assert words.known == [b"the", b"cat,"] and words.encode([]) == [] and words.encode([b"", b" "]) == [b"", b""]
    assert words.encode([b""]) == [b""] and words.encode([b"", b""]) == [b"", b""]


def check_packing(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_of_whole_texts(docs, corpus, tokenizer, capacity):
    rows = pack_texts(docs, WORDS, capacity=capacity).collect()
    want = {}
    for doc, text, _ in corpus:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[start : start + capacity], "<u4")
            want[doc, piece] = (start, len(own), zlib.crc32(own.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert check_packing(rows, capacity) <= 1.01 * sum(n for _, n, _ in want.values()) / capacity + 1


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once_and_waste_little(seed):
    rng = np.random.default_rng(seed)
    lengths = [
        np.minimum(100, 1 + rng.geometric(0.05, 4000)), np.full(997, 51), np.full(1000, 1), rng.integers(34, 67, 3000), np.array([100, 99, 1, 98, 2, 3]), np.array([], int),
    ][seed]
    counts = np.bincount(lengths, minlength=101)
    used = Counter()
    fill = Counter()
    for run in plan_packing(counts, 100):
        assert used[run.length] == run.rank
        used[run.length] += run.times * run.per
        for sequence in range(run.sequence, run.sequence + run.times):
            assert fill[sequence] == run.offset
            fill[sequence] += run.length * run.per
    assert used == Counter(lengths.tolist())
    assert all(n <= 100 for n in fill.values())
    # First fit decreasing is a fair yardstick.
    bins = []
    for n in sorted(lengths.tolist(), reverse=True):
        at = next((i for i, held in enumerate(bins) if held + n <= 100), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    assert len(fill) <= len(bins) * 1.01


def test_packing_of_odd_rows(odd, nothing):
    rows = pack_texts(odd, WORDS).collect()
    assert len(rows) == 6 and check_packing(rows, 2048) == 1 and min(r.length for r in rows) == 1
    assert pack_texts(nothing, WORDS).collect() == []


def test_segmentations_without_dropout_are_the_vocabularys_own(corpus):
    import sentencepiece

    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES), Pieces(PIECES)
    for _, text, _ in corpus:
        if text and "▁" not in text and "\x00" not in text:
            assert np.frombuffer(pieces.encode(text, 0), np.uint32).tolist() == model.encode(text)


def test_dropout_varies_and_decodes_losslessly(docs, corpus):
    texts = {doc: text or "" for doc, text, _ in corpus}
    seen = {}
    for seed in (1, 2):
        coded = docs.withColumn("ids", encode_pieces(PIECES, "text", F.col("doc_id"), seed=seed))
        rows = coded.withColumn("back", decode_pieces(PIECES, "ids")).select("doc_id", "ids", "back").collect()
        assert {r.doc_id: r.back for r in rows} == texts
        seen[seed] = {r.doc_id: bytes(r.ids) for r in rows}
    differ = sum(seen[1][doc] != seen[2][doc] for doc in texts if len(texts[doc]) > 200)
    assert differ > 0.9 * sum(len(t) > 200 for t in texts.values())
    again = docs.repartition(2).select("doc_id", encode_pieces(PIECES, "text", F.col("doc_id"), seed=2).alias("ids")).collect()
    assert {r.doc_id: bytes(r.ids) for r in again} == seen[2]


def test_skips_happen_at_the_asked_rate():
    pieces = Pieces(PIECES)
    text = " ".join(random.Random(1).choices(["the", "token", "banana", "running"], k=50))
    sizes = []
    for rate in (0.0, 0.1, 0.5, 1.0):
        pieces.set(rate, 3)
        sizes.append(np.mean([len(pieces.encode(text, variant)) // 4 for variant in range(20)]))
    assert sizes == sorted(sizes) and sizes[0] < sizes[1] < sizes[2] < sizes[3] == len(text) + 1


def test_both_agendas_agree():
    pieces, rng = Pieces(PIECES), random.Random(1)
    pieces.set(0.2, 5)
    for _ in range(2000):
        symbols = [pieces.place[c] for c in rng.choices("abcdehorstin", k=rng.randint(1, 24))]
        key = rng.getrandbits(64)
        assert pieces._merge_few(list(symbols), key) == pieces._merge_many(list(symbols), key)


def test_every_occurrence_draws_for_itself():
    pieces = Pieces(PIECES)
    pieces.set(0.1, 3)
    word = "internationalisation"

    def cuts(document):
        text = " ".join([word] * 300)
        out, held = [], b""
        for i in np.frombuffer(pieces.encode(text, document), np.uint32).tolist():
            if pieces.bytes[i].startswith(b" ") and held:
                out.append(held)
                held = b""
            held += pieces.bytes[i] + b"|"
        return [*out, held]

    one, other = cuts(1), cuts(2)
    assert len(set(one)) > 10 and len(set(one) | set(other)) > len(set(one)) and one != other
    # Draws are independent: the chance that a whole agenda is worked off without a skip.
    outcome, places = pieces.outcome(" " + word), 20_000
    skipped = len(pieces._first_skips([outcome] * places, pieces._keys(1, places))[0])
    assert 1 - skipped / places == pytest.approx(0.9 ** (len(outcome.candidates) // 8), abs=0.02)


def test_occurrences_with_skips_are_not_remembered():
    pieces = Pieces(PIECES)
    pieces.set(0.3, 3)
    words = ["internationalisation", "\u2581odd\u4e00\U0001f600", "x" * 40]
    text = " ".join(words * 300)
    got = pieces.encode_all([text, "", text], [7, 8, 9])
    assert pieces.size == len(words) - 1 and got[1] == b"" and got[0] != got[2]
    for document, ids in zip((7, 9), (got[0], got[2])):
        keys = pieces._keys(document, 900).tolist()
        assert ids == b"".join(pieces.stretch_ids(" " + word, key) for word, key in zip(words * 300, keys))


def test_stretches_are_those_of_the_pattern(corpus):
    texts = [text or "" for _, text, _ in corpus]
    texts += ["", " ", "\n", "\n\n a  b \n", "  a", "a  ", "x\n\n", "\u2581 \u00a0\u3000\n \ud800", "\t\r a\tb"]
    cut, counts = merge_dropout._stretches(texts)
    wanted = [merge_dropout._STRETCH.findall(" " + text) if text else [] for text in texts]
    assert counts.tolist() == list(map(len, wanted))
    assert [s.decode("utf-8", "surrogatepass") for s in cut.to_pylist()] == [s for own in wanted for s in own]
    assert [len(x) for x in merge_dropout._stretches([])] == [0, 0]


def test_a_stretch_is_looked_up_once_for_all_its_occurrences():
    class Counted(dict):
        looked_up = 0

        def __getitem__(self, stretch):
            Counted.looked_up += 1
            return super().__getitem__(stretch)

    pieces = Pieces(PIECES)
    pieces.set(0.1, 3)
    pieces.known = Counted()
    texts = ["internationalisation, of words\n" * 500] * 3
    got = pieces.encode_all(texts, [1, 2, 1])
    assert got[0] == got[2] != got[1] and Counted.looked_up < 20


def test_decoding_together(corpus):
    pieces = Pieces(PIECES)
    pieces.set(0.2, 5)
    texts = [text or "" for _, text, _ in corpus] + ["", "\u2581 \u4e00\U0001f600", "\n"]
    assert pieces.decode_all(pieces.encode_all(texts, list(range(len(texts))))) == texts
    assert pieces.decode_all([]) == [] and pieces.decode_all([b""]) == [""]


def test_outcomes_are_those_of_the_agenda(corpus):
    pieces = Pieces(PIECES)
    pieces.set(0.2, 5)
    texts = [text or "" for _, text, _ in corpus]
    got = pieces.encode_all(texts, list(range(len(texts))))
    for document, text in enumerate(texts):
        assert got[document] == Pieces.encode(pieces, text, document)
        parts = [p.stretch if p.__class__ is not str else p for s in merge_dropout._STRETCH.findall(" " + text) for p in pieces.known[s]] if text else []
        keys = pieces._keys(document, len(parts)).tolist()
        assert got[document] == b"".join(map(pieces.stretch_ids, parts, keys))


def test_merge_dropout_of_odd_rows(odd, nothing):
    coded = odd.withColumn("ids", encode_pieces(PIECES, "text", F.col("doc_id")))
    assert sorted(r.back for r in coded.select(decode_pieces(PIECES, "ids").alias("back")).collect()) == sorted(
        r.text or "" for r in odd.select("text").collect()
    )
    assert nothing.withColumn("ids", encode_pieces(PIECES, "text", F.col("doc_id"))).collect() == []


def test_quality_of_held_out_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = op4_quality_classifier(spark, sf_dir).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.85 * len(held)


def test_quality_on_a_larger_sample(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, marks = [], []
    for doc in range(500):
        body = rng.choices(words, k=rng.randint(20, 120))
        good = doc % 5 != 0
        rows.append((doc, " ".join(body if good else [w.upper() + "!!" for w in body])))
        marks.append((doc, int(good), 0))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert all(got[doc].predicted == good for doc, good, _ in marks if got[doc].held_out)
    # Held-out labels, whatever they say, change no score.
    other = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in classify(docs, other).collect()} == {d: r.score for d, r in got.items()}
    assert keep_good(docs, labels).count() == sum(r.predicted for r in got.values())


def test_scores_are_those_of_the_library(spark, sf_dir):
    """Every score again, with the same dictionaries: plain compression of the pieces of a text, one by one."""
    import math

    import zstandard

    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 50_000)], "doc_id long, text string"))
    model = quality.fit_quality(docs, labels)
    settings = zstandard.ZstdCompressionParameters.from_level(quality.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)

    def size(text, own):
        at_once = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(own), compression_params=settings)
        step = quality.PIECE_BYTES
        return sum(len(at_once.compress(text[at : at + step])) for at in range(0, max(1, len(text)), step))

    got = {r.doc_id: r.score for r in classify(docs, labels).collect()}
    for row in docs.collect():
        text = (row.text or "").encode()
        good, bad = size(text, model.good), size(text, model.bad)
        per_byte = max(1, len(text))
        x = [1, (bad - good) / max(good, bad), min(1.25, good / per_byte), min(1.25, bad / per_byte)]
        total = sum(w * one for w, one in zip(model.weights, x))
        assert got[row.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9)


def test_repeated_ids_fit_one_model(spark):
    """Of several texts with one id the same one is used, in whatever order the rows come."""
    rng = random.Random(6)
    rows = [(doc, "".join(rng.choices("abcd " if doc % 2 else "WXYZ!", k=200))) for doc in range(60) for _ in range(3)]
    labels = spark.createDataFrame([(doc, doc % 2) for doc in range(60)], "doc_id long, quality int")
    models = set()
    for _ in range(3):
        rng.shuffle(rows)
        model = quality.fit_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(rng.randint(2, 9)), labels)
        models.add((model.good, model.bad, tuple(model.weights)))
    assert len(models) == 1


def test_quality_without_labels_and_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = classify(odd, labels).collect()
    assert len(rows) == 6 and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {0}
    assert classify(nothing, labels).collect() == []
    assert keep_good(odd, labels).columns == odd.columns
    model = fit_sample([b"aaaa bbbb", b"aaaa cccc", b"XX!!", b"YY!!"], [True, True, False, False])
    assert quality._curve(quality._Sizes(model.good, model.bad).features([b"", b"x"]) @ model.weights).shape == (2,)


def test_cross_entropy_difference_against_plain_counts(docs, corpus, tokenizer):
    cells, (start, end) = 97, WORD_BPE_EDGES
    target = {doc for doc, _, _ in corpus if doc % 3 == 0}
    ids = {doc: tokenizer.encode(text or "", add_special_tokens=False).ids for doc, text, _ in corpus}
    vocabulary = tokenizer.get_vocab_size(with_added_tokens=True)

    def cell(a, b):
        return int(lm.cell_of(np.array([a], np.uint32), np.array([b], np.uint32), cells)[0])

    pairs = {doc: list(zip([start, *own], [*own, end])) for doc, own in ids.items()}
    places = {pair: cell(*pair) for own in pairs.values() for pair in own}
    counts = [(Counter(), Counter(), Counter()) for _ in range(2)]
    for doc, own in pairs.items():
        for which in (0, 1) if doc in target else (1,):
            for a, b in own:
                for counter, key in zip(counts[which], (places[a, b], a, b)):
                    counter[key] += 1
    sizes = [sum(c[1].values()) for c in counts]

    def loss(which, a, b):
        scale = 1.0 if which == 0 else sizes[0] / sizes[1]
        cell_n, context, following = (c * scale for c in (counts[which][0][places[a, b]], counts[which][1][a], counts[which][2][b]))
        share = (following + lm.TOKEN_WEIGHT) / (sizes[which] * scale + lm.TOKEN_WEIGHT * vocabulary)
        return -math.log((min(cell_n, context) + lm.CONTEXT_WEIGHT * share) / (context + lm.CONTEXT_WEIGHT))

    target_ids = docs.where("doc_id % 3 = 0").select("doc_id")
    rows = score_documents(docs, target_ids, WORDS, start, end, cells=cells).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        want = [sum(loss(which, a, b) for a, b in pairs[r.doc_id]) / len(pairs[r.doc_id]) for which in (0, 1)]
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.target_loss == pytest.approx(want[0], rel=1e-4) and r.background_loss == pytest.approx(want[1], rel=1e-4)
        assert r.difference == pytest.approx(r.target_loss - r.background_loss)


@pytest.mark.parametrize("frequent", [1 << 20, 100, 0])
def test_bigrams_are_counted_exactly(spark, monkeypatch, tokenizer, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng, (start, end) = random.Random(11), WORD_BPE_EDGES
    names = [w[:-4] for w in sorted(tokenizer.get_vocab()) if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha()][:400]
    texts = {doc: " ".join(rng.choices(names, k=rng.randint(0, 800))) for doc in range(60)}
    ids = {doc: tokenizer.encode(text, add_special_tokens=False).ids for doc, text in texts.items()}
    pairs = {doc: list(zip([start, *own], [*own, end])) for doc, own in ids.items()}
    distinct = np.array(sorted({pair for own in pairs.values() for pair in own}), np.uint32)
    assert len(set(lm.cell_of(distinct[:, 0], distinct[:, 1], 1 << 21).tolist())) < len(distinct)  # a fixed table mixes some
    vocabulary = tokenizer.get_vocab_size(with_added_tokens=True)
    counts = [[Counter(part(pair) for doc in pairs if chosen(doc) for pair in pairs[doc]) for part in (lambda p: p, lambda p: p[0], lambda p: p[1])]
              for chosen in (lambda doc: doc % 3 == 0, lambda doc: True)]
    sizes = [sum(c[0].values()) for c in counts]

    def loss(which, pair):
        scale = sizes[0] / sizes[which]
        both, context, following = (c[key] * scale for c, key in zip(counts[which], (pair, *pair)))
        share = (following + lm.TOKEN_WEIGHT) / (sizes[0] + lm.TOKEN_WEIGHT * vocabulary)
        return -math.log((both + lm.CONTEXT_WEIGHT * share) / (context + lm.CONTEXT_WEIGHT))

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = score_documents(docs, docs.where("doc_id % 3 = 0").select("doc_id"), WORDS, start, end).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = [sum(loss(which, pair) for pair in pairs[r.doc_id]) / len(pairs[r.doc_id]) for which in (0, 1)]
        assert (r.n_tokens, r.target_loss, r.background_loss) == (len(ids[r.doc_id]), pytest.approx(want[0], rel=1e-9), pytest.approx(want[1], rel=1e-9))


def test_the_target_scores_lower(spark):
    rng = random.Random(3)
    rows = [(doc, " ".join(rng.choices(["cat", "dog", "bird"] if doc % 2 else ["tax", "law", "court"], k=30))) for doc in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = score_documents(docs, docs.where("doc_id % 2 = 1 AND doc_id < 30").select("doc_id"), WORDS, *WORD_BPE_EDGES).collect()
    assert max(r.difference for r in got if r.doc_id % 2) < min(r.difference for r in got if not r.doc_id % 2)


def test_scoring_of_odd_rows(odd, nothing):
    rows = score_documents(odd, odd.select("doc_id").limit(0), WORDS, *WORD_BPE_EDGES).collect()
    assert len(rows) == 6 and all(math.isfinite(r.difference) for r in rows)
    assert score_documents(nothing, nothing.select("doc_id"), WORDS, *WORD_BPE_EDGES).collect() == []
