"""Operators against plain versions of themselves, over texts that cover nulls, ties, repeats, long texts and clashing names."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatewright.llm import bpe, cdc, packing, phrases, pii, quality, simhash
from gatewright.llm.components import components
from gatewright.llm.exact_dedup import exact_dedup, exact_groups
from gatewright.llm.line_dedup import line_dedup
from gatewright.llm.packing import pack_documents
from gatewright.llm.pii import find_pii
from gatewright.llm.repeats import remove_repeats
from gatewright.llm.simhash import links, near_components, near_dedup
from gatewright.llm.substring_dedup import substring_dedup

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, th string, fp string, row string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def frame(spark, rows, parts=3):
    """Rows (doc_id, text) with further columns, some named like the operators' own."""
    return spark.createDataFrame([(d, t, "en", "s", None, 7, "x", "y", "z") for d, t in rows], SCHEMA).repartition(parts)


def words(r, n):
    return " ".join("".join(r.choice("aeiourstln") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    shared, passage = words(r, 12), words(r, 90)
    out = [(None, "No id but a text of its own, long enough."), (1, None), (2, ""), (3, " \t\n"), (4, "short"), (5, "Ünïcödé — 漢字かな\n" * 3)]
    for i in range(10, 40):
        text = words(r, r.randint(5, 160)) + "\n" + (shared.upper() if i % 3 else "  " + shared + " ") * (i % 4 > 0) + "\n" + words(r, 30)
        if i % 5 == 0:
            text += " " + passage
        out.append((i, text))
    copy = words(r, 200)
    out += [(50 + i, copy) for i in range(6)] + [(60, copy.replace(" ", "  ")), (61, copy[:900] + "zz" + copy[902:])]
    out += [(70, "tick " * 400), (71, "ab" * 5000), (72, words(r, 20000)), (73, "a" * 399), (74, "b" * 400), (75, "c" * 401), (76, copy[:399]), (77, copy[:400])]
    out += [(80, "the same row"), (80, "the same row"), (81, "the  same row")]
    return out


EMPTY_OK = [
    lambda d: line_dedup(d), lambda d: exact_groups(d), lambda d: exact_dedup(d), lambda d: near_components(d), lambda d: near_dedup(d), lambda d: substring_dedup(d), lambda d: remove_repeats(d),
    lambda d: find_pii(d), lambda d: phrases.fingerprint_documents(d), lambda d: quality.score_quality(d, quality.RuleModel(0.0)),
    lambda d: pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")), lambda d: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
]


@pytest.mark.parametrize("i", range(len(EMPTY_OK)))
def test_empty_tables(spark, i):
    assert EMPTY_OK[i](frame(spark, [], 1)).count() == 0


# 1


def plain_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    holders = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(-(2**63) if d is None else d)
    common = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (key(x) in common and (-(2**63) if d is None else d) < common[key(x)])]
        yield d, len(lines), len(lines) - len(left), "\n".join(left)


def test_line_dedup(spark, rows):
    more = rows + [(90 + i, "all lines of this one are common\nall lines of this one are common") for i in range(4)]
    got = Counter(tuple(r) for r in line_dedup(frame(spark, more)).collect())
    assert got == Counter(plain_lines(more)) and any(r[2] for r in got)


# 2


def test_bpe_equals_the_library_and_returns_the_bytes(spark, rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["'s 're\x1c\x85 x　y", "x" * 3000, "é漢" * 700, "<|endoftext|>", " " * 900 + "a", "\U0001f600" * 200, "a\n\n  b\t\tc"]
    more = rows + [(100 + i, t) for i, t in enumerate(odd)]
    want = Counter()
    for d, t in more:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want[d, len(ids), sha(ids.tobytes()), sha(t or ""), tuple(ids.tolist()), (t or "").encode()] += 1
    got = bpe.encode_documents(frame(spark, more), path, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), bytes(r.decoded)) for r in got) == want


def test_bpe_words_of_all_lengths_and_decoding_from_ids(monkeypatch):
    """Words about as long as the bounds of a stride and of a recursion; a wrong id decodes to other bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Coder(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    monkeypatch.setattr(bpe, "BYTES", 3000)
    monkeypatch.setattr(bpe, "TOKENS", 50)
    r = random.Random(4)
    texts = ["".join(r.choice(a) for _ in range(n)) for n in (1, 15, 16, 17, 18, 250, 900) for a in ("etaoinshr", "a", "漢字語文éß", "0123456789", "\U0001f600!?")]
    texts += ["", "a" * 4096, "b" * 4097, *("".join(r.choice("etaoinshrdlu") for _ in range(250)) for _ in range(100))]
    ids, ends = own.encode(texts)
    lists = [ids[i:j].tolist() for i, j in zip([0, *ends], ends)]
    assert lists == [library.encode_ordinary(t) for t in texts]
    assert own.decode(ids, ends) == [t.encode() for t in texts]
    wrong = ids.copy()
    wrong[0] += 1
    assert own.decode(wrong, ends)[0] != texts[0].encode() and own.decode(wrong, ends)[1:] == [t.encode() for t in texts[1:]]


def test_bpe_of_a_text_of_50_mb():
    """Coded and decoded in pieces of one text, by an engine that has 400 MB."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Coder(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(8)
    text = " ".join("".join(r.choice("etaoinshrdlué") for _ in range(r.randint(1, 9))) for _ in range(100_000)) + " 漢 \n"
    text *= 50_000_000 // len(text.encode()) + 1
    assert len(text.encode()) >= 50_000_000
    ids, ends = own.encode([text])
    assert ends.tolist() == [len(ids)] and np.array_equal(ids, np.array(library.encode_ordinary(text), np.uint32))
    assert own.decode(ids, ends) == [text.encode()]
    both, ends = own.encode(["a b", ""])
    assert own.decode(np.concatenate([both, ids[:1_500_000], both]), np.array([len(both), len(both), len(both) + 1_500_000, 2 * len(both) + 1_500_000])) == [b"a b", b"", library.decode_bytes(ids[:1_500_000].tolist()), b"a b"]


# 3


def test_packing(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    more = rows + [(100, "special <|endoftext|> text"), (101, "漢字 and latin"), (102, "nbsp\xa0\x85\x1cx")]
    got = pack_documents(frame(spark, more), path).collect()
    want = Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in more)
    found, pieces = Counter(), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id, r.doc_tokens].append((r.start, tuple(r.ids)))
    repeated = [k for k, v in pieces.items() if sum(len(i) for _, i in v) != k[1]]
    assert repeated == [(80, repeated[0][1])]  # the row that is there twice
    for (d, n), own in pieces.items():
        by_start = defaultdict(list)
        for start, ids in own:
            by_start[start].append(ids)
        times = sum(len(i) for _, i in own) // n
        whole = [p for p in sorted(own)]
        if times == 1:
            assert [s for s, _ in whole] == np.cumsum([0, *(len(i) for _, i in whole)])[:-1].tolist()
            found[d, sum((i for _, i in whole), ())] += 1
        else:
            flat = np.zeros(n, int)
            for start, ids in own:
                flat[start : start + len(ids)] += 1
            assert (flat == times).all()
    assert found == Counter({k: v for k, v in want.items() if k[0] != 80})
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length, r.tier, r.step_group))
    padding = 0
    for own in windows.values():
        own.sort()
        n = sum(x[1] for x in own)
        assert [x[0] for x in own] == np.cumsum([0, *(x[1] for x in own)])[:-1].tolist() and n <= own[0][2] <= 1024
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding <= 3 * 1024
    groups = defaultdict(int)
    for own in windows.values():
        groups[own[0][3]] += own[0][2]
    assert max(groups.values()) <= 8192


def test_fast_ids_are_used_only_where_both_libraries_agree():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing._special(path) == ("<|endoftext|>",)
    for t in ("plain text, naïve", "a <|endoftext|> b", "漢字", "x\x85y", "", " " * 1_000_000 + "a"):
        assert packing.token_ids(t, path).tolist() == Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids


# 4 and 10


def test_cuts_move_with_the_text():
    r = random.Random(1)
    text = words(r, 3000).encode()
    for cut in (lambda t: cdc.cuts([t], 8, 64, 2048)[0], lambda t: cdc.least_cuts([t], 32)[0].tolist()):
        a, b = cut(text), cut(b"some words before " + text)
        assert a[-1] == len(text) and len(set(a) & {x - 18 for x in b}) > 0.95 * len(a)
    many = [words(r, n).encode() for n in (0, 1, 30, 500, 0, 40)]
    for together, alone in ((cdc.cuts(many, 5, 16, 99), [cdc.cuts([t], 5, 16, 99)[0] for t in many]), (cdc.least_cuts(many, 24), [cdc.least_cuts([t], 24)[0] for t in many])):
        assert [list(x) for x in together] == [list(x) for x in alone]


def test_gear_equals_its_sum():
    data = np.frombuffer(words(random.Random(2), 20).encode(), np.uint8)
    want = [sum(int(cdc.GEAR[data[i - k]]) << k for k in range(min(i + 1, cdc.WINDOW))) % 2**32 for i in range(len(data))]
    assert cdc.gear(data).tolist() == want


def test_substring_dedup_drops_repeats_and_leaves_the_rest(spark, rows):
    got = {r.doc_id: r for r in substring_dedup(frame(spark, [x for x in rows if x[0] != 80])).collect()}
    text = dict(rows)
    for d, r in got.items():
        assert r.n_bytes == len((text[d] or "").encode()) and r.n_removed == r.n_bytes - len(r.kept_text.encode()) and (r.n_spans > 0) == (r.n_removed > 0)
    passage = [d for d in range(10, 40) if d % 5 == 0]
    assert got[passage[0]].n_removed < got[passage[1]].n_removed and all(got[d].n_removed > 300 for d in passage[1:])
    assert got[50].n_removed == 0 and all(got[d].n_removed == got[d].n_bytes for d in range(51, 56))
    assert got[72].n_removed == 0 and got[11].kept_text.startswith(text[11][:20])
    assert all(got[d].n_removed == 0 for d in (None, 1, 2, 3, 4, 5))


def plain_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        yield len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())


def test_repeats_equal_brute_force(spark, rows):
    r = random.Random(9)
    base = words(r, 400)
    edits = []
    for i in range(12):
        cut = r.randint(0, 1500)
        edits.append((200 + i, words(r, 20) + base[cut : cut + r.randint(350, 1200)] + r.choice(["", "x", base[:430]]) + words(r, 5)))
    more = rows + edits + [(300, "tick " * 79), (301, base[100:499] + "é"), (302, "é" + base[100:500])]
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame(spark, more)).collect())
    want = sorted(((d is not None, d or 0), *x) for (d, _), x in zip(more, plain_repeats([(t or "").encode() for _, t in more], 400)))
    assert got == want and sum(w[2] > 0 for w in want) > 10


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_a_small_alphabet(spark, seed):
    r = random.Random(seed)
    block = ["".join(r.choice("ab") for _ in range(r.randint(20, 260))) for _ in range(6)]
    docs = [(i, "".join(r.choice(block) for _ in range(r.randint(0, 9)))) for i in range(25)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(frame(spark, docs), 150).collect())
    assert got == sorted((d, *x) for (d, _), x in zip(docs, plain_repeats([t.encode() for _, t in docs], 150)))


# 5


def test_exact_dedup(spark, rows):
    bare = lambda t: "".join(c for c in t or "" if c not in BLANK)
    groups = defaultdict(list)
    for d, t in rows:
        groups[bare(t)].append((-len(t or ""), -(2**63) if d is None else d))
    want = Counter()
    for d, t in rows:
        own = groups[bare(t)]
        keep = min(own)[1]
        want[d, None if keep == -(2**63) else keep, len(own), sha(bare(t))] += 1
    for name in (None, lambda chunk, salt: hashlib.md5(bytes([salt]) + chunk).digest()[: 1 + 8 * (salt > 0)]):  # the second clashes under its first salt
        got = exact_groups(frame(spark, rows), *([name] if name else [])).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns and left.count() == len(groups)


# 6

KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_exact_spans_equal_the_patterns():
    r = random.Random(4)
    for _ in range(4000):
        text = "".join(r.choice(["a", "b.", "@", "x@y", ".", "1", "25", "256.", "0.", "4", "+", "(", ") ", "-", " ", "é", "%", "\n", "4111 1111 1111 1111", "+1 555 0100 222", "@a.b"]) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    for long in ("1" * 200_000, "a@" * 50_000, "1." * 50_000, "+1" + "(" * 100_000, "a" * 200_000 + "@"):
        pii.base_spans(long)


def test_field_finds_held_out_entities_and_leaves_decoys():
    w, r = pii.train_field(), random.Random(1234)
    hit = said = true = 0
    for _ in range(400):
        text, truth = pii.training_line(r)
        got = pii.Lattice(text, [m.span() for m in pii.TOKEN.finditer(text)]).best(w)
        hit, said, true = hit + len(set(got) & set(truth)), said + len(got), true + len(truth)
    assert hit / true > 0.93 and hit / said > 0.93


def test_stored_weights_are_those_of_training():
    assert np.allclose(pii.field_weights(), pii.train_field(), atol=5e-3)


def test_the_best_segmentation_is_the_best_of_all():
    """Against every way to cut short runs of tokens, under random weights."""
    rng, r = np.random.default_rng(5), random.Random(6)

    def every(ending, n):
        """(score, entities) of all segmentations of the first n tokens."""
        if n == 0:
            return [(0.0, [])]
        out = every(ending, n - 1)
        for i, _, s in ending[n]:
            out = out + [(v + float(x), [*e, (i, n, k)]) for v, e in every(ending, i) for k, x in enumerate(s)]
        return out

    tried = 0
    while tried < 25:
        text, _ = pii.training_line(r)
        lattice = pii.Lattice(text, [m.span() for m in pii.TOKEN.finditer(text)][:6])
        if not any(lattice.ending):
            continue
        tried += 1
        w = rng.normal(size=(len(pii.KINDS), pii.FEATURES))
        score, entities = max(every(lattice.scores(w), lattice.n), key=lambda x: x[0])
        assert lattice.best(w) == entities and score >= 0


def test_field_spans_touch_no_exact_one():
    w, r = pii.field_weights(), random.Random(21)
    for _ in range(300):
        text = " ".join(pii.training_line(r)[0] for _ in range(3)) + r.choice(["", " a@b.co", " +49 170 1234567", " 10.1.2.3"])
        base, every = pii.all_spans(text, w)
        touching = [s for s in pii.field_spans(text, w) if any(s[0] < b[2] and b[0] < s[2] for b in base)]
        assert sorted(base + [s for s in pii.field_spans(text, w) if s not in touching]) == every


def test_field_is_a_distribution():
    """The gradient is the difference of the log likelihood, found by trying small steps."""
    text, truth = next(x for x in (pii.training_line(random.Random(i)) for i in range(50)) if len(x[1]) == 2)
    lattice = pii.Lattice(text, [m.span() for m in pii.TOKEN.finditer(text)])
    rng = np.random.default_rng(0)
    w = rng.normal(size=(len(pii.KINDS), pii.FEATURES)) * 0.3
    g = np.zeros_like(w)
    lattice.gradient(w, truth, g)

    def likelihood(w):
        ahead = [0.0]
        for own in lattice.scores(w)[1:]:
            ahead.append(np.logaddexp.reduce([ahead[-1], *(ahead[i] + x for i, _, s in own for x in s)]))
        score = sum(s[k] for a, b, k in truth for i, _, s in lattice.scores(w)[b] if i == a)
        return score - ahead[-1]

    for k, f in ((0, 0), (1, 1), (2, 7), (3, 0)):
        step = np.zeros_like(w)
        step[k, f] = 1e-5
        assert g[k, f] == pytest.approx((likelihood(w + step) - likelihood(w - step)) / 2e-5, abs=1e-5)


def test_find_pii(spark):
    docs = [(1, None), (2, ""), (3, "née à a.b@c.org, 10.0.0.1 or 4111 1111 1111 1111; call +1 (555) 010-2222."), (4, "nothing here"), (5, 'token = "' + "ab12" * 10 + '" end'), (None, "x@y.z")]
    got = {r.row.doc_id: r for r in find_pii(frame(spark, docs)).collect()}
    r = got[3]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.base == ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in plain_spans(docs[2][1])) and set(r.base.split(",")) <= set(r.spans.split(","))
    assert r.clean == "née à [EMAIL], [IP] or [CARD]; call [PHONE]."
    assert got[1].spans == got[2].spans == got[4].spans == "" and got[4].clean == "nothing here"
    assert got[5].base == "" and got[5].spans == "secret:9:49" and got[5].clean == 'token = "[SECRET]" end' and got[None].n_email == 1
    assert pii.redacted("abcdef", [(0, 0, 3), (2, 1, 4)]) == "[EMAIL]ef"


# 7


def test_quality_is_learned_and_compiled(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    assert 0 < len(model.rules) < 120 and all(len(r) <= 3 for r in model.rules)
    scored = quality.score_quality(docs, model).select("row.doc_id", "score").join(labels, "doc_id").toPandas()
    held = scored[[zlib.crc32(str(d).encode()) % 5 == 0 for d in scored.doc_id]]
    assert ((held.score >= 0.3) == (held.quality == 1)).mean() > 0.95
    some = quality.score_quality(docs.limit(20), model).select("row.text", "score").collect()
    for r in some:
        x = quality.text_stats(r.text.encode())
        z = model.bias + sum(w for rule, w in zip(model.rules, model.weights) if all((x[j] > b) == above for j, above, b in rule))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)))
    assert model == quality.fit_quality(docs.repartition(7), labels)


def test_quality_edges(spark, rows):
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(11, 1), (12, None), (None, 1), (13, 0)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        got = quality.score_quality(docs, quality.fit_quality(docs, given))
        assert got.count() == len(rows) and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert quality.fit_rules(np.zeros((4, len(quality.STATS))), np.ones(4)).rules == []


# 8


def test_phrases_do_not_depend_on_neighbours_and_keep_their_inside():
    r = random.Random(3)
    texts = [words(r, n).encode() for n in (0, 1, 3, 40, 300, 0, 900)] + [b"a" * 500, b"ab" * 300, b"\xff\x00\xff"]
    assert all((a == phrases.sketches([t])[0]).all() for a, t in zip(phrases.sketches(texts), texts))
    x, shifted = texts[6], b"another start " + texts[6]
    for level in range(1, 4):
        names = []
        for t in (x, shifted):
            s, starts = np.frombuffer(t, np.uint8), np.array([0, len(t)])
            for _ in range(level):
                s, starts = phrases.parse(s, starts)
            names.append(s)
        assert len(set(names[0]) & set(names[1])) > 0.9 * len(set(names[0])) - 3
    assert phrases.likeness(*phrases.sketches([x, shifted])) > 0.85
    assert phrases.likeness(*phrases.sketches([x, texts[4]])) < 0.1 and phrases.likeness(*phrases.sketches([b"", b""])) == 1.0 and phrases.likeness(*phrases.sketches([b"", b"a"])) == 0.0


M = 2**64 - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_toss(a, b):
    """Twice the lowest place where a and b differ, and a's bit there."""
    i = next(i for i in range(64) if (a ^ b) >> i & 1)
    return 2 * i + (a >> i & 1)


def plain_parse(symbols, of_bytes):
    """One level of one text, symbol by symbol, by the definition: runs, coin tossing, local maxima, names."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    if not runs:
        return []
    label = [s for s, _ in runs]
    for k in range(3 if of_bytes else 4):
        against = [~label[0] & M if k == 0 and not of_bytes else label[0] ^ 1, *label[:-1]]
        label = [plain_toss(a, b) for a, b in zip(label, against)]
    assert all(x < 6 for x in label)
    names = [plain_mix(s) if of_bytes else s for s, _ in runs]
    names = [x if n == 1 else plain_mix(x + n * 0xD6E8FEB86659FD93 & M) for x, (_, n) in zip(names, runs)]
    begin = [0] + [i for i in range(2, len(names) - 1) if label[i - 1] < label[i] > label[i + 1]]
    power = lambda k: pow(0x9E3779B97F4A7C15, k + 1, M + 1)
    return [plain_mix(sum(x * power(k) for k, x in enumerate(names[i:j])) + j - i & M) for i, j in zip(begin, [*begin[1:], len(names)])]


def test_fingerprints_equal_the_definition():
    r = random.Random(13)
    texts = [b"", b"a", b"aa", b"ab", b"aab" * 9, words(r, 60).encode(), words(r, 7).encode(), bytes(r.choices(range(256), k=700)), b"a" * 300 + b"b" * 3, "漢字 é".encode() * 20]
    for text, got in zip(texts, phrases.sketches(texts)):
        level, names, keys = 1, plain_parse(list(text), True), set()
        while names:
            level, names = level + 1, plain_parse(names, False)
            keys |= {plain_mix(x + level & M) >> 32 for x in names}
            if len(names) == 1:
                break
        assert got.tolist() == sorted(keys)[:64]


def test_fingerprints_of_many_rows_of_one_id(spark):
    """A null id and one other have most rows; each row is followed by the next by id and hash of the text."""
    from pyspark.sql import functions as F

    given = [(None, f"without id {i}") for i in range(300)] + [(7, f"seven {i}") for i in range(300)] + [(i, f"own {i}") for i in range(8, 60)] + [(None, "")] * 40
    docs = frame(spark, given)
    hashes = {x.text: x.h for x in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(given, key=lambda x: (-(2**63) if x[0] is None else x[0], hashes[x[1]]))
    want = Counter()
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        want[d, sha(t[: len(t) - len(t) // 2] + following[: len(t) // 2])] += 1
    for buckets in (1, 9, 64):
        assert Counter((x.doc_id, x.edited_sha256) for x in phrases.fingerprint_documents(docs, buckets).collect()) == want


def test_parsing_halves_each_level():
    r = random.Random(8)
    s, starts = np.frombuffer(words(r, 2000).encode(), np.uint8), None
    starts = np.array([0, len(s)])
    while len(s) > 1:
        new, starts = phrases.parse(s, starts)
        assert len(new) <= max(1, (len(s) + 1) // 2 + 1) and starts.tolist() == [0, len(new)]
        s = new


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_fingerprints_meet_the_next_document(spark, rows, buckets):
    own = sorted(((-(2**63) if d is None else d), t or "") for d, t in rows if d != 80)
    got = {r.doc_id: r for r in phrases.fingerprint_documents(frame(spark, [x for x in rows if x[0] != 80]), buckets).collect()}
    assert len(got) == len(own)
    for i, (d, t) in enumerate(own):
        r, following = got[None if d == -(2**63) else d], own[(i + 1) % len(own)][1]
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert (r.n_chars, r.edited, r.edited_sha256) == (len(t), e, sha(e))
        a, b, c = phrases.sketches([t.encode(), e.encode(), following.encode()])
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (phrases.written(a), phrases.written(b), phrases.likeness(a, b), phrases.likeness(a, c))
    assert phrases.fingerprint_documents(frame(spark, rows), buckets).count() == len(rows)
    assert phrases.fingerprint_documents(frame(spark, [(5, "alone here")])).first().edited == "alone" + "alone"


# 9


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = list(fps)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= 3 and find(a) != find(b):
                root[find(a)] = find(b)
    return {f: find(f) for f in own}


def test_near_components(spark, rows):
    want = {(d, t): plain_simhash(t or "") for d, t in rows}
    root = reach(set(want.values()))
    least = defaultdict(lambda: 2**63)
    for (d, _), f in want.items():
        least[root[f]] = min(least[root[f]], -(2**63) if d is None else d)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in near_components(frame(spark, rows)).collect())
    named = lambda x: None if x == -(2**63) else x
    assert got == Counter((d, f"{want[d, t]:016x}", named(least[root[want[d, t]]])) for d, t in rows)
    left = near_dedup(frame(spark, rows))
    assert left.count() == len(least) and left.columns == frame(spark, rows).columns


@pytest.mark.parametrize("seed", range(3))
def test_links_connect_what_lies_within_three_bits(spark, seed):
    r = random.Random(seed)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        f = r.getrandbits(64)
        fps.add(f)
        for _ in range(r.randint(0, 12)):
            for b in r.sample(range(64), r.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    found = components(links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")))
    root = {r.node: r.root for r in found.collect()}
    want, mine = reach(fps), defaultdict(set)
    for f in fps:
        mine[root.get(simhash._signed(f), simhash._signed(f))].add(f)
    groups = defaultdict(set)
    for f in fps:
        groups[want[f]].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))
    for x in links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")).collect():
        assert ((x.a ^ x.b) % 2**64).bit_count() <= 3


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (100, 150), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and got[200] == got[150] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_extra_columns_survive(spark, rows):
    assert exact_dedup(frame(spark, rows).withColumn("drop", F.lit(1))).select("drop", "row", "fp").distinct().count() == 1


def test_repeats_of_known_lengths(spark):
    """Of planted passages just those of 400 bytes or more go, alone or on either side of a shorter one."""
    r = random.Random(77)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    plants = {n: text(n) for n in (271, 330, 394, 399, 400, 401, 520, 900)}
    given, want = [], {}
    for n, plant in plants.items():
        for _ in range(3):
            # The byte beside a plant differs from one text to the next, so that no match outgrows it.
            edge = chr(33 + len(given))
            want[len(given)] = n if n >= 400 else 0
            given.append((len(given), text(r.randint(50, 700)) + edge + plant + edge + text(r.randint(50, 700))))
    short, long = plants[399], plants[400]
    want[len(given)] = 400
    given.append((len(given), "A" + short + "B" + long + "C"))
    found = remove_repeats(frame(spark, given + [(None, plants[900] + f"\n{i}") for i in range(200)])).collect()
    assert {x.doc_id: x.n_removed for x in found if x.doc_id is not None} == want
    assert {x.n_removed for x in found if x.doc_id is None} == {901, 902, 903}
