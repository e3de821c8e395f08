"""Each operator against a brute-force version on small tables, odd rows included."""

import base64
import hashlib
import itertools
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartwise.llm import bilstm, bpe, chat, exact_dedup, fingerprints, line_dedup, near_dedup, packing, pii, token_files, toxicity
from cartwise.llm.tokens import Encoder, default_path
from cartwise.session import scratch_path

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE = r"[\x20\x09-\x0D]+"


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def u4(ids):
    return np.array(ids, "<u4").tobytes()


def prose(seed, words, pick=400):
    dice = random.Random(seed)
    return " ".join(f"w{dice.randrange(pick)}" for _ in range(words))


# Fingerprints


def test_fingerprints(documents, odd):
    data = [(i, t) for i, t in odd if i is not None and i != 5] + [(5, "one"), (20, prose(1, 300)), (21, prose(2, 300))]
    out = {r.doc_id: r for r in fingerprints.fingerprint_pairs(documents(data)).collect()}
    ids = sorted(i for i, _ in data)
    texts = {i: t or "" for i, t in data}
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert out[i].n_chars == len(text)
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
        if edited == text:
            assert out[i].near_edited == 1 and out[i].fingerprint == out[i].edited_fingerprint
    assert out[4].fingerprint == out[5].fingerprint and out[4].near_next == 1
    assert abs(out[20].near_edited - 0.6) < 0.15 and out[20].near_next < 0.1


def test_fingerprints_of_repeated_ids_and_of_nothing(documents, odd):
    assert fingerprints.fingerprint_pairs(documents(odd)).count() == len(odd)
    assert fingerprints.fingerprint_pairs(documents([])).count() == 0


def test_likeness_follows_the_true_resemblance(spark):
    base = prose(3, 400, 10**6).split()
    for share in (0.3, 0.6, 0.9):
        cut = int(400 * share)
        other = base[:cut] + prose(4, 400 - cut, 10**6).split()
        df = spark.createDataFrame([(" ".join(base), " ".join(other))], "a string, b string")
        near = df.select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b")))).first()[0]
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (base, other)]
        assert abs(near - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.12


# Personal data


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and pii._luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_spans_equal_the_plain_patterns():
    dice = random.Random(5)
    pieces = ["a", "B.", "@", "x@y.zz", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "4539 1488 0343 6467", "+1 (546) 555-5100", "_", "é", "\n"]
    for _ in range(3000):
        text = "".join(dice.choice(pieces) for _ in range(dice.randrange(25)))
        assert pii.base_spans(text) == plain_base(text), text


def test_pii_report_and_mask(documents, odd):
    data = [*odd, (30, "mail ab.c@de.example.com or 10.1.2.3, +1 (546) 555-5100, 4539 1488 0343 6467."), (31, "x" * 200 + " a@b.cd " + "9" * 70)]
    docs = documents(data)
    out = {r.doc_id: r for r in pii.span_report(docs).collect()}
    for i, text in data:
        if i in (30, 31):
            spans = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_base(text))
            assert out[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
            assert set(spans.split(",")) <= set(out[i].spans.split(","))
    clean = {r.doc_id: r.text for r in pii.masked(docs, pii.fit(docs, steps=5)).collect()}
    assert clean[30] == "mail <EMAIL> or <IP>, <PHONE>, <CARD>."
    assert pii.span_report(documents([])).count() == 0


def test_the_tagger_learns_and_joins_windows(spark):
    dice = random.Random(6)
    number = lambda n: "".join(dice.choice("0123456789") for _ in range(n))
    texts = [
        f"{prose(k, dice.randrange(30))} {dice.choice([f'u{number(2)}@mail{number(1)}.example.com', f'+1 ({number(3)}) 555-{number(4)}'])} {prose(k + 1, 20)}"
        for k in range(600)
    ]
    model = pii.fit(spark.createDataFrame([(t,) for t in texts[:500]], "text string"))
    found = pii.tagged_spans(texts[500:], model)
    want = [plain_base(t) for t in texts[500:]]
    hits = sum(len(set(a) & set(b)) for a, b in zip(found, want, strict=True))
    assert hits >= 0.8 * sum(map(len, want))


def personal(dice):
    number = lambda n: "".join(dice.choice("0123456789") for _ in range(n))
    card = "4" + number(14)
    return dice.choice([
        f"{dice.choice(['ann', 'jo.b', 'x_y'])}{number(2)}@mail{number(1)}.example.{dice.choice(['com', 'org'])}",
        ".".join(str(dice.randrange(256)) for _ in range(4)),
        next(card + d for d in "0123456789" if pii._luhn(card + d)),
        f"+1 ({number(3)}) 555-{number(4)}",
    ])


def test_the_tagger_adds_spans_that_the_patterns_miss(spark):
    dice = random.Random(16)
    texts = [f"{prose(k, dice.randrange(30))} {personal(dice)} {prose(k + 1, 20)} {personal(dice)}." for k in range(500)]
    clean = [f"{prose(k, 9)} {dice.randrange(10**6)} in {dice.randrange(1900, 2030)}-{dice.randrange(10, 13)}-10, v1.{k}" for k in range(200)]
    model = pii.fit(spark.createDataFrame([(t,) for t in texts[:350]], "text string"))
    held = [pii.altered(t, 99) for t in texts[350:]]
    found = pii.tagged_spans([text for text, _ in held], model)
    missed = [set(spans) - set(plain_base(text)) for text, spans in held]
    hits = [len(want & set(got)) for want, got in zip(missed, found, strict=True)]
    assert sum(map(len, missed)) > 150 and sum(hits) >= 0.9 * sum(map(len, missed))
    extra = sum(len(set(got) - set(spans) - set(plain_base(text))) for (text, spans), got in zip(held, found, strict=True))
    assert extra <= 0.05 * sum(hits)
    assert sum(map(bool, pii.tagged_spans(clean, model))) <= 2
    report = pii.find_spans(spark.createDataFrame([(t,) for t, _ in held], "text string"), model)
    assert report.selectExpr("sum(size(filter(pii, s -> not s.base)))").first()[0] >= sum(hits)


def test_altered_texts_carry_their_spans():
    dice = random.Random(17)
    for k in range(300):
        text = f"é {personal(dice)} and {personal(dice)} {prose(k, 5)}"
        changed, spans = pii.altered(text, k % 3)
        assert (changed, spans) == pii.altered(text, k % 3)
        for start, kind, end in spans:
            assert pii._plausible(kind, changed, start, end), (changed, spans)
    assert pii.altered("", 0) == ("", []) and pii.altered("no data", 1) == ("no data", [])


def test_long_stretches_are_decoded_in_pieces(monkeypatch):
    dice = random.Random(18)
    text = " ".join(f"{personal(dice)} of {dice.randrange(10**5)}, then" for _ in range(600))
    made = [w for v in range(4) for w in pii._labelled(*pii.altered(text, v))]
    x, y = (np.array([w[k] for w in made]) for k in (0, 1))
    model = bilstm.train(x, y, pii._CLASSES, pii.TAGS, 250)
    monkeypatch.setattr(pii, "LONG", 10**6)
    whole = pii.tagged_spans([text, ""], model)
    assert len(whole[0]) > 300
    for long, group in ((64, 100), (40, 1)):
        monkeypatch.setattr(pii, "LONG", long)
        monkeypatch.setattr(pii, "GROUP", group)
        assert len(set(whole[0]) ^ set(pii.tagged_spans([text, ""], model)[0])) <= 2


def test_crf_equals_brute_force_and_its_gradients_the_differences():
    dice = np.random.default_rng(19)
    model = bilstm.start_model(4, 3, seed=3)
    model["trans"] = dice.normal(0, 1, (3, 3))
    x, y = dice.integers(0, 4, (2, 5)), dice.integers(0, 3, (2, 5))
    scores = bilstm.emissions(model, x)
    total = lambda e, tags: e[range(5), tags].sum() + sum(model["trans"][a, b] for a, b in itertools.pairwise(tags))
    every = [list(tags) for tags in itertools.product(range(3), repeat=5)]
    losses = [np.log(sum(np.exp(total(e, t)) for t in every)) - total(e, list(gold)) for e, gold in zip(scores, y, strict=True)]
    loss, grads = bilstm._step(model, x, y)
    assert abs(loss - np.mean(losses)) < 1e-9
    assert [list(p) for p in bilstm.viterbi(model, scores)] == [max(every, key=lambda t: total(e, t)) for e in scores]
    for name, grad in grads.items():
        for _ in range(4):
            at = tuple(dice.integers(0, n) for n in grad.shape)
            sides = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in model.items()}
                moved[name][at] += step
                sides.append(bilstm._step(moved, x, y)[0])
            assert abs((sides[0] - sides[1]) / 2e-5 - grad[at]) < 1e-6, name


# Tokens


def test_pieces_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    dice = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "a", "B", "É", "é", "12", "'s", "'S", "!", ".", ",", "　", "\xa0", "\x1c", "\x85", "<|endoftext|>", "日", "Σ", "İ", " \n", "½"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randrange(30))) for _ in range(4000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own, library = Encoder(default_path(name)), Tokenizer.from_file(default_path(name))
        library.encode_special_tokens = True
        for text, whole in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.encode(text) == u4(whole.ids), repr(text)


def test_a_batch_gives_the_ids_of_each_text(monkeypatch):
    from cartwise.llm import tokens

    dice = random.Random(9)
    texts = ["", " ", "x" * 200 + " y", *(" ".join(dice.choice(["ab", "", "é", "x" * 60, "a\nb", "c."]) for _ in range(dice.randrange(40))) for _ in range(300))]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        want = [Encoder(default_path(name)).encode(t) for t in texts]
        monkeypatch.setattr(tokens, "CALL", 3)
        monkeypatch.setattr(tokens, "ROOM", 4)  # the pieces are forgotten again and again
        own = Encoder(default_path(name))
        for size in (1, 7, len(texts)):
            assert [e for i in range(0, len(texts), size) for e in own.encode_all(texts[i : i + size])] == want
        assert all(len(p) <= tokens.LONGEST for p in [*own.first, *own.rest])


def test_runs_go_to_the_model_once_and_without_the_library_s_split(monkeypatch):
    from cartwise.llm import tokens

    texts = pa.array(["Éte foo, foo.\nbar 12a (foo)", "", "foo it's x", "a  b foo"])
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own, seen, split = Encoder(default_path(name)), [], []
        merged, whole = own._merged, own._whole
        monkeypatch.setattr(own, "_merged", lambda runs: seen.extend(runs) or merged(runs))
        monkeypatch.setattr(own, "_whole", lambda pieces: split.extend(pieces) or whole(pieces))
        flat, ends = own.encode_column(texts)
        want = [own.tokenizer.encode(t.as_py(), add_special_tokens=False).ids for t in texts]
        assert [part.tolist() for part in np.split(flat, ends[:-1])] == want
        assert len(seen) == len(set(seen)) and {p.strip() for p in split} <= {"it's", "", "a"}  # a: before two blanks
    batch = pa.record_batch([pa.array(["x" * 50, None, "y" * 500, "z"] * 10)], ["text"])
    cut = list(tokens.text_slices([batch], 0, 300))
    assert pa.Table.from_batches(cut).combine_chunks() == pa.Table.from_batches([batch]) and len(cut) > 10


def test_pieces_of_known_runs_cost_no_call(monkeypatch):
    from cartwise.llm import tokens

    letters = [chr(c) for c in range(33, 0x250)] + ["\n", "a\nb", "12", "3!"]
    dice = random.Random(5)
    texts = pa.array([" ".join("".join(dice.choices(letters, k=dice.randrange(1, 6))) for _ in range(50)) for _ in range(40)])
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = Encoder(default_path(name))
        for column in (texts, texts.slice(3), texts.cast(pa.large_string())):
            flat, ends = own.encode_column(column)
            want = [own.tokenizer.encode(t.as_py(), add_special_tokens=False).ids for t in column]
            assert [part.tolist() for part in np.split(flat, ends[:-1])] == want
        own.encode_column(pa.array(["x foo bar z. z, z) z1"]))
        for method in ("_merged", "_whole"):
            monkeypatch.setattr(own, method, lambda new: pytest.fail(f"{new} known or made of known runs") if new else {})
        own.encode_column(pa.array(["x foo, bar) foo. bar1"]))  # other pieces, the same runs
        assert not {"foo,", " foo,"} & {*own.first, *own.rest}


def test_workers_give_back_what_arrow_holds(monkeypatch):
    from cartwise.llm import common, tokens

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append("slices"))
    monkeypatch.setattr(tokens, "give_back", lambda: calls.append("texts"))
    batch = pa.record_batch([pa.array(["x" * 50] * 40)], ["text"])
    assert sum(b.num_rows for b in common.slices([batch, batch], 15)) == 80 and calls == ["slices"] * 2
    assert sum(b.num_rows for b in tokens.text_slices([batch], 0, 1100)) == 40 and calls[2:] == ["texts"] * 2


def test_long_texts_reach_the_workers_in_small_batches(spark, monkeypatch):
    from cartwise.llm import common

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda it: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in it)
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        monkeypatch.setattr(common, "BATCH_BYTES", 100_000)
        docs = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
        toxicity.score(docs, {"lexicon": {}, "trees": (0.0, []), "knots": (np.array([]), np.array([]))})
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 200
        spark.conf.set(key, "64k")  # a limit that was set stays
        common.text_batches(spark)
        assert spark.conf.get(key) == "64k"
    finally:
        spark.conf.set(key, before)


def test_bpe_of_repeated_rows_longer_than_a_block(spark, documents):
    text = "one two three one two " * 30
    docs = documents([(1, text)] * 5 + [(2, text), (None, text), (None, text)]).coalesce(1)
    got = rows(bpe.decode(bpe.encode(docs, block_chars=100)), "doc_id", "decoded")
    assert Counter((i, bytes(d)) for i, d in got.elements()) == Counter({(1, text.encode()): 5, (2, text.encode()): 1, (None, text.encode()): 2})


def test_bpe_round_trip(documents, odd):
    import public_tokenizers
    import tiktoken

    with open(default_path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for block in (50, 10**6):  # also blocks smaller than a text
        docs = documents(odd)
        got = rows(bpe.decode(bpe.encode(docs, block_chars=block)), "doc_id", "ids", "decoded")
        want = Counter((i, u4(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in odd)
        assert Counter((a, bytes(b), bytes(c)) for (a, b, c) in got.elements()) == want
    assert bpe.digests(documents([])).count() == 0


def test_token_files(spark, documents, odd):
    folder = scratch_path(spark, "tokens")
    token_files.write_token_files(documents(odd), folder)
    own = Encoder(default_path("byte_bpe_50k.json"))
    start, want = 0, Counter()
    for i, t in sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = own.encode(t or "") + u4([0])
        want[i, start, len(ids) // 4, zlib.crc32(ids)] += 1
        start += len(ids) // 4
    assert rows(token_files.read_token_files(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32") == want
    empty = scratch_path(spark, "tokens")
    token_files.write_token_files(documents([]), empty)
    assert token_files.read_token_files(spark, empty).count() == 0


# Copies


def test_exact_groups(documents, odd):
    data = [*odd, (40, "Same TEXT é"), (41, "same text é"), (42, "same text É")]
    out = exact_dedup.exact_groups(documents(data))
    groups = defaultdict(list)
    for i, t in data:
        groups[(t or "").translate(LOWER)].append(i)
    want = Counter()
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, digest, once = (max(known) if known else None), hashlib.sha256(body.encode()).hexdigest(), True
        for i in ids:
            kept = i == keep and once
            once &= not kept
            want[i, keep, len(ids), kept, digest] += 1
    assert rows(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_groups(documents([])).count() == 0


def test_colliding_keys_are_chained_by_their_bytes(documents):
    data = [(i, f"text {i % 3}") for i in range(9)]
    out = exact_dedup.exact_groups(documents(data), key=lambda c: F.length(c).cast("long"))
    assert rows(out, "doc_id", "keep_id", "group_size") == Counter((i, 6 + i % 3, 3) for i in range(9))


def test_long_chains_are_cut_into_pages(documents):
    data = [(i, f"Text {i % 2}") for i in range(200)]
    for key in (F.xxhash64, lambda c: F.lit(-5).cast("long")):
        out = exact_dedup.exact_groups(documents(data), capacity=8, key=key)
        assert rows(out, "doc_id", "keep_id", "group_size") == Counter((i, 198 + i % 2, 100) for i in range(200))


def test_overfull_buckets_split(spark):
    entries = spark.range(3000).select(F.xxhash64("id").alias("key"), F.col("id").alias("doc_id"))
    directory, index = exact_dedup.build_index(entries, capacity=64)
    sizes = [r["count"] for r in index.groupBy("bucket").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 64 and len(sizes) > 47
    depths = {r.bucket: (r.depth, r.bucket_depth) for r in directory.collect()}
    for r in index.collect():
        depth, own = depths[r.bucket]
        top = (r.key & (2**64 - 1)) >> (64 - own) if own else 0
        assert r.bucket == top << (depth - own)


def test_rows_reach_their_chains_through_the_directory(documents, monkeypatch):
    whole = exact_dedup._directory
    monkeypatch.setattr(exact_dedup, "_directory", lambda *a: whole(*a).where("bucket > 0"))
    data = [(i, f"text {i}") for i in range(64)]
    assert 0 < exact_dedup.exact_groups(documents(data), capacity=4).count() < 64


def brute_near(data, size):
    sets = []
    for i, t in data:
        w = [x for x in re.split(SPACE, (t or "").translate(LOWER)) if x]
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    group = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for (a, s), (b, t) in itertools.combinations(sets, 2):
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
                changed = True
    return Counter((i, len(s), group[i], group[i] == i) for i, s in sets)


@pytest.mark.parametrize("size", [4, 5])
def test_near_groups(documents, odd, size):
    data = [(i, t) for i, t in odd if i is not None and t != "two words here"]
    base = prose(8, 120, 10**6).split()
    dice = random.Random(9)
    for k in range(60):  # a group of near copies, some linked only through others
        words = list(base)
        for _ in range(dice.randrange(6)):
            words[dice.randrange(len(words))] = f"z{dice.randrange(10**6)}"
        data.append((100 + k, " ".join(words)))
    data += [(200 + k, prose(8, 120, 10**6)) for k in range(20)]
    out = near_dedup.near_groups(documents(data), size=size)
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == brute_near(data, size)


def test_near_groups_of_nothing(documents, odd):
    assert near_dedup.near_groups(documents(odd)).count() == len(odd)
    assert near_dedup.near_groups(documents([])).count() == 0
    assert rows(near_dedup.near_groups(documents([(None, None), (None, "a b")])), "doc_id", "kept") == Counter({(None, True): 2})


def brute_lines(data, least):
    norm = lambda x: re.sub(SPACE, " ", x.translate(LOWER)).strip(" ")
    places = [(k, j, norm(line)) for k, (_, t) in enumerate(data) if t is not None for j, line in enumerate(t.split("\n"))]
    places = [p for p in places if len(p[2]) >= least]
    lines = sorted({p[2] for p in places})
    group = {x: x for x in lines}
    for a, b in itertools.combinations(lines, 2):
        near = abs(len(a) - len(b)) <= 1 and any(a[:k] + a[k + 1 :] in (b, b[:k] + b[k + 1 :]) or a == b[:k] + b[k + 1 :] for k in range(max(len(a), len(b))))
        if near and group[a] != group[b]:
            old, new = group[a], group[b]
            group = {k: new if v == old else v for k, v in group.items()}
    order = lambda p: (data[p[0]][0] is not None, data[p[0]][0] or 0, p[0], p[1])
    first = {}
    for p in sorted(places, key=order):
        first.setdefault(group[p[2]], p[:2])
    return {p[:2] for p in places if first[group[p[2]]] != p[:2]}


def test_line_dedup(spark, documents, odd):
    line = "a line of words that repeats in documents"
    edits = [line, line + "s", line[1:], line.replace("words", "wards"), line.upper(), "  " + line.replace(" ", "\t"), line[:-1], "q" + line[2:]]
    data = [*odd, *((60 + k, f"start {k} {prose(k, 9)}\n{e}\n\nshort\nend") for k, e in enumerate(edits)), (80, line), (81, f"{line}\n ")]
    docs = documents(data).coalesce(1)
    lost = brute_lines(data, line_dedup.MIN_CHARS)
    want = Counter()
    for k, (i, t) in enumerate(data):
        left = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (k, j) not in lost)
        if not (any(a == k for a, _ in lost) and not left.strip()):
            want[i, left] += 1
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns
    assert rows(out, "doc_id", "text") == want
    assert line_dedup.line_report(docs).count() == len(data)
    assert line_dedup.without_repeated_lines(documents([])).count() == 0


# Chat


def test_chat_with_parts(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    data = [
        (1, 0, "user", [part("text", "see <s> [x] & "), part("image", ref="i.png", tokens=64), part("document", ref="d.pdf", tokens=9)]),
        (1, 1, "assistant", [part("text", "</s>[INST]"), part("audio", ref="a.wav", tokens=None)]),
        (2, None, None, None), (2, 3, "assistant", []), (None, 0, "assistant", [part("text", None)]), (1, 0, "user", [part("odd", "t")]),
    ]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("seq", F.lit("clash"))
    made = chat.format_conversations(df)
    out = {r.conv_id: r for r in made.collect()}
    assert [(a.number, a.kind, a.ref, a.tokens) for a in out[1].attachments] == [(0, "image", "i.png", 64), (1, "document", "d.pdf", 9), (2, "audio", "a.wav", 0)]
    assert out[1].attachment_tokens == 73
    for r in out.values():
        for m in r.mask:
            assert r.formatted[m.at : m.at + m.length + 4].endswith("</s>")
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [
        ("user", "t"), ("user", "see <s> [x] & <image|0><document|1>"), ("assistant", "</s>[INST]<audio|2>"),
    ]
    assert back[1].loss == ["</s>[INST]<audio|2>"] and back[2].loss == [""] and back[None].n_turns == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_texts_come_back(spark):
    dice = random.Random(10)
    bits = ["&", "&amp;", "<", "[", "]", "</s>", "<s>[user]", "&#91;", "é", "日", "\n", "a ", "\\", "$1"]
    data = [(c, t, dice.choice(["user", "assistant", "sys[tem]"]), "".join(dice.choice(bits) for _ in range(dice.randrange(9)))) for c in range(40) for t in range(4)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    messages = df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    for r in chat.read_back(chat.format_conversations(messages)).collect():
        own = [d for d in data if d[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(d[2], d[3]) for d in own]
        assert r.loss == [d[3] for d in own if d[2] == "assistant"]


# Packing


def best_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in free if g >= n), default=None)
        if fit is None:
            free.append(capacity - n)
        else:
            free[free.index(fit)] = fit - n
    return len(free)


@pytest.mark.parametrize("shape", ["mixed", "ties", "small", "large"])
def test_best_fit(spark, shape):
    dice = random.Random(11)
    sizes = {
        "mixed": lambda: min(100, int(dice.lognormvariate(3, 1)) + 1), "ties": lambda: dice.choice([34, 34, 34, 21]),
        "small": lambda: dice.randrange(1, 9), "large": lambda: dice.randrange(40, 101),
    }[shape]
    lengths = [sizes() for _ in range(600)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    placed = packing.best_fit(pieces, 100).collect()
    assert sorted(p.uid for p in placed) == list(range(600))
    sequences = defaultdict(list)
    for p in placed:
        sequences[p.sequence_id].append((p.offset, lengths[p.uid]))
    for own in sequences.values():
        assert all(a == b for (a, _), b in zip(sorted(own), itertools.accumulate((n for _, n in sorted(own)), initial=0)))
        assert sum(n for _, n in own) <= 100
    assert len(sequences) <= 1.03 * best_fit_decreasing(lengths, 100) + 1


def test_tasks_of_a_sweep_follow_its_rows(spark, monkeypatch):
    dice = random.Random(12)
    pieces = spark.createDataFrame([(k, dice.randrange(1, 60)) for k in range(400)], "uid long, length long").cache()
    parts = []
    stored = packing.stored

    def seen(df, label):
        out = stored(df, label)
        if label == "swept":
            parts.append(out.select("part").distinct().count())
        return out

    monkeypatch.setattr(packing, "stored", seen)
    one = {tuple(r) for r in packing.best_fit(pieces, 100).collect()}
    assert set(parts) == {1}  # however many shuffle partitions there are
    parts.clear()
    monkeypatch.setattr(packing, "SWEPT_ROWS", 60)
    assert {tuple(r) for r in packing.best_fit(pieces, 100).collect()} == one and parts[0] > 3


def test_packing_documents(documents, odd):
    out = packing.pack_documents(documents(odd), capacity=64).collect()
    own = Encoder(default_path("word_bpe_49k.json"))
    want = Counter()
    for i, t in odd:
        ids = own.encode(t or "") + u4([1])
        for k in range(0, len(ids), 256):
            want[i, k // 256, k // 4, len(ids[k : k + 256]) // 4, zlib.crc32(ids[k : k + 256])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert packing.pack_documents(documents([])).count() == 0


# Toxicity


def test_toxicity_learns_what_is_held_out(spark, documents):
    dice = random.Random(12)
    data, labels = [], []
    for i in range(600):
        bad = i % 5 == 0 or i % 7 == 0
        words = prose(i, 60).split()
        for _ in range(3 * bad):
            words.insert(dice.randrange(60), dice.choice(["grobword", "vileword", "nastyone"]))
        data.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.scored_with_holdout(documents(data + [(None, None), (601, "")]), labels).collect()
    assert len(out) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(r.predicted == (r.doc_id % 5 == 0 or r.doc_id % 7 == 0) for r in held)
    assert right >= 0.97 * len(held)


def test_toxicity_without_labels_or_documents(spark, documents, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored_with_holdout(documents(odd), none).count() == len(odd)
    some = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.scored_with_holdout(documents([]), some).count() == 0


def test_isotonic_is_monotone():
    dice = np.random.default_rng(13)
    margin = dice.normal(size=500)
    y = (dice.random(500) < 1 / (1 + np.exp(-3 * margin))).astype(float)
    knots = toxicity.fit_isotonic(margin, y)
    score = toxicity.calibrated(np.sort(margin), knots)
    assert (np.diff(score) >= 0).all() and abs(score.mean() - y.mean()) < 0.03


def test_stages_keep_columns_whatever_their_names(spark):
    from cartwise.llm import stages

    names = ["_id", "_row", "_lost", "_kept", "_gone", "score", "predicted", "pii", "kept", "d", "gone"]
    data = [(1, "a long line that is repeated in two documents\nmail me@example.org"), (2, "a long line that is repeated in two documents\nother"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(f"own {name} "), F.col("doc_id").cast("string")))
    for stage in (stages.drop_toxic, stages.drop_repeated_lines, stages.drop_near_copies, stages.mask_personal_data):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, stage.__name__
        for r in out.collect():
            assert all(r[n] == f"own {n} {r.doc_id}" for n in names)
        assert {3, 4} <= {r.doc_id for r in out.collect()}


def test_a_text_of_very_many_equal_lines(spark, documents):
    text = "\n".join(["the same line again and again and again"] * 100_000)
    out = line_dedup.without_repeated_lines(documents([(1, text), (2, "another line that nobody else has at all")])).collect()
    assert sorted((r.doc_id, len(r.text)) for r in out) == [(1, 39), (2, 40)]
