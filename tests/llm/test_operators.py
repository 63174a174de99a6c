"""Every operator against brute force, and on odd tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lumenframe.llm import chat, chunk_dedup, decontaminate, html_text, lm_score, mixing, near_dup, quality, textkit, token_shards, vector_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, score double, kept boolean, bucket string, shallow string, component_id long, `a.b` int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("ba de fi go lu mo ne pa ri su ta vo wu xe zi".split()) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    base = words(60, 1)
    texts = [base, base, base.upper(), base + " one more", words(40, 2), None, "", "  \t\n", "just two", "just two", "é ü   ñ", words(20000, 3), "x" * 50000, base.replace("ba", "BA"), words(300, 4), words(300, 4) + " end"]
    rows = [(i, t, "en", [None, "s0", "s1", "s0"][i % 4], len(t or ""), 5, 6, 0.5, True, "b", "k", 9, i) for i, t in enumerate(texts)]
    rows.append((None, "no id here at all friend", "en", "s0", 3, None, None, None, None, None, None, None, None))
    rows.append((4, texts[4], "en", "s0", 7, 1, 1, 1.0, False, "c", "k", 0, 1))
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def sets_of(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_turns_read_back_whole():
    """Texts and roles that hold marks, backslashes and very long runs come back; nothing else is read as a turn."""
    turns = [("user", "a </turn>\n### x: y"), ("a:\\#<", "\\"), ("", ""), ("assistant", "\\### Assistant: </turn> ok"), ("x\\", "ends in a backslash\\"), ("user", "ab <c> #d\\ " * 400_000)]
    window = "".join(chat.write_turn(*t)[0] for t in turns)
    assert chat.read_turns(window) == turns
    for bad in ("### user: no end", "user: x </turn>\n", window + "x"):
        with pytest.raises(ValueError):
            chat.read_turns(bad)


def test_op4_query(spark, sf):
    """Every conversation of a table, and the one that holds the template's marks."""
    got = chat.op4_chat_windows(spark, sf).toPandas().set_index("conv_id")
    t = pd.read_parquet(f"{sf}/conversations.parquet")
    by = {c: [(r.role or "", r.text or "") for r in g.sort_values("turn").itertuples()] for c, g in t.groupby("conv_id")}
    by[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    assert set(got.index) == set(by)
    for c, turns in by.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got.loc[c][["n_turns", "turns_sha256", "loss_chars", "loss_sha256"]]) == want


def test_items_in_several_blocks(spark, odd, monkeypatch):
    long = words(20000, 3).split()
    bench = spark.createDataFrame([(i, " ".join(long[50 * i : 50 * i + 9 + i])) for i in range(20)] + [(None, words(60, 1))], "item_id long, text string")
    whole = sorted(map(str, decontaminate.contained_items(odd, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 4)
    assert sorted(map(str, decontaminate.contained_items(odd, bench).collect())) == whole and len(whole) > 20


def test_shingles_are_exact():
    import pyarrow as pa

    texts = ["a b c d e f", "A b\tc d e F", "", None, "a b", "x " * 9]
    found = [s for _, _, _, sh in textkit.shingled(pa.array(texts)) for s in sh.sets()]
    assert [len(s) for s in found] == [len(sets_of(t)) for t in texts]
    assert (found[0] == found[1]).all()


# --- 1 -----------------------------------------------------------------------------------------


def plain_pairs(symbols):
    """Most occurrences of any pair that don't overlap."""
    best, at = Counter(), {}
    for i, p in enumerate(zip(symbols, symbols[1:], strict=False)):
        if at.get(p, -2) < i - 1:
            best[p] += 1
            at[p] = i
    return max(best.values(), default=0)


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 5), (2, 1), (5000, 3), (3000, 50_000), (999, 1), (4000, 200_000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        symbols, rules, lengths = token_shards.repair(ids, 200_000)
        g = token_shards.Grammar(*map(token_shards.planes, (symbols, rules.ravel(), lengths)), 200_000)
        assert (g.ids() == ids).all() and (g.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()
        assert all((g.ids(i, i + 3) == ids[i : i + 3]).all() for i in range(0, n, 97))
        assert len(symbols) <= n and plain_pairs(symbols.tolist()) < 2


def test_repair_of_repeats():
    """A text of 17 equal parts keeps about one part's pairs: rules aren't rationed."""
    part = np.random.default_rng(1).integers(0, 50_000, 60_000).astype(np.uint32)
    symbols, rules, lengths = token_shards.repair(np.tile(part, 17), 50_257)
    assert len(symbols) < 1000 and len(rules) < 70_000 and lengths.max() > 10_000


def test_tokens(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    from lumenframe.plans.staging import new_path

    got = token_shards.read_shards(token_shards.write_shards(odd, new_path(spark, "t"), path, shard_tokens=2000)).orderBy("start").collect()
    at, want = 0, []
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    for r in rows:
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_shards.read_shards(token_shards.write_shards(empty, new_path(spark, "t"), path)).count() == 0


def test_pieces_equal_whole_encoding(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, coder = Tokenizer.from_file(path), token_shards.Encoder(Tokenizer.from_file(path))
    texts = ["a b", " a", "a ", " ", "", "a\nb", "a \n b", "don't we'll\n\nx", "a\x00b c", "no\u00a0break x", "\n", "\u3000 a", "end.\nNext 12 3", "tab\tx y", "a<|endoftext|>b c", "x\n", "\u0301a b\u0301", "end\u2028 x", None]
    texts += [words(200, k) for k in range(40)]
    monkeypatch.setattr(token_shards, "KNOWN", 300)  # pieces are forgotten and learnt anew
    for lo in range(0, len(texts), 7):
        part = texts[lo : lo + 7]
        ids, counts = coder.encode(pa.array(part, pa.string()))
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in part]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(coder.known) < 1500


def test_op1_query(spark, sf):
    """The query on a whole table against direct encoding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: tuple(r)[1:] for r in token_shards.op1_repair_tokens(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# --- 2 -----------------------------------------------------------------------------------------


def test_scores(odd, empty):
    got = lm_score.score_texts(odd, "doc_id % 3 <> 0").collect()
    rows = odd.select("doc_id", "text").collect()
    count = Counter()
    for r in rows:
        if r["doc_id"] is None or r["doc_id"] % 3:
            count.update([*(r["text"] or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    want = {}
    for r in rows:
        t = [*(r["text"] or "").encode().lower().split(), None]
        want[r["doc_id"]] = (len(t), sum(count[x] > 0 for x in t), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t))
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (w[0], w[1], n)
        assert r["base_score"] == pytest.approx(w[2]) and r["score"] < 0
    assert lm_score.score_texts(empty, "true").count() == 0


def test_rare_words_are_joined(odd, monkeypatch):
    more = odd.select("doc_id", "text").unionByName(odd.select((odd.doc_id % 3).alias("doc_id"), "text"))
    key = lambda r: (r["doc_id"] or -1, r["n_tokens"], round(r["score"], 6))
    whole = {key(r): r for r in lm_score.score_texts(more, "true").collect()}
    monkeypatch.setattr(lm_score, "HEAD", 50)
    for r in lm_score.score_texts(more, "true").collect():
        assert r["n_known"] == whole[key(r)]["n_known"] and r["base_score"] == pytest.approx(whole[key(r)]["base_score"])


def spaced(x):
    return x in b" \t\n\x0b\x0c\r"


def plain_contexts(raw, i):
    """The contexts of byte i, as they are: up to two, four and six bytes before, and the word so far."""
    begin = i
    while begin and not spaced(raw[begin - 1]):
        begin -= 1
    return [("last", k, raw[max(0, i - k) : i]) for k in lm_score.ORDERS] + [("word", raw[begin:i])]


def plain_spelling(code, raw, i):
    before = 0x20 if not i or spaced(raw[i - 1]) else raw[i - 1]
    symbol = (int(code.kind[before]) << 8) | raw[i]
    at = range(code.first[symbol], code.first[symbol] + code.size[symbol])
    return [(int(code.node[k]), int(code.bit[k])) for k in at]


def plain_bits(code, counts, raw):
    """Bits of a text by the definition, one decision after another."""
    level = lambda n: int(lm_score.LEVELS[lm_score.LEVELS <= n][-1])
    seen = lambda n: (n > 0) + (n > 3) + (n > 30)
    decisions = [(c, node, bit) for i in range(len(raw)) for node, bit in plain_spelling(code, raw, i) for c in [plain_contexts(raw, i)]]
    weights, bits, t, step = {}, 0.0, 0, lm_score.FIRST_STEP
    while t < len(decisions):
        back = Counter()
        for contexts, node, bit in decisions[t : t + step]:
            p, zs, gate = 0.5, [], 0
            for c, context in enumerate(contexts):
                n0, n1 = (level(counts[(context, node, k)]) for k in (0, 1))
                if c >= len(contexts) - 2:
                    gate = gate * 4 + seen(n0 + n1)
                odds = (n1 + lm_score.PRIOR[c] * p) / (n0 + lm_score.PRIOR[c] * (1 - p))
                odds = min(max(odds, lm_score.LEAST_ODDS), 1 / lm_score.LEAST_ODDS)
                zs.append(math.log(odds))
                p = odds / (1 + odds)
            w = weights.setdefault(gate, list(lm_score.START))
            x = sum(a * z for a, z in zip(w, zs[1:], strict=True)) * (2 * bit - 1)
            miss = math.exp(-max(-14, min(14, x)))
            bits += math.log2(1 + miss)
            for k, z in enumerate(zs[1:]):
                back[gate, k] += z * miss / (1 + miss) * (2 * bit - 1)
        for (gate, k), x in back.items():
            weights[gate][k] += x * lm_score.RATE / step**0.5
        t += step
        step *= 2 if t >= 32 * step else 1
    return bits


def test_score_equals_the_definition(spark, monkeypatch):
    texts = [words(n, k) for k, n in enumerate((3, 40, 90, 200, 700, 41))] + ["", None, "Ab aB\n\tab  abab é", words(40, 1) + " more", "zz" * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [(t or "").encode().lower() + b"\xff" for t in texts]
    pairs = np.zeros((256, 256), np.int64)
    for k, r in enumerate(raw):
        if k % 3:
            for i in range(len(r)):
                pairs[0x20 if not i or spaced(r[i - 1]) else r[i - 1], r[i]] += 1
    code, counts = lm_score.Code(pairs), Counter()
    for k, r in enumerate(raw):
        if k % 3:
            for i in range(len(r)):
                counts.update((c, node, bit) for c in plain_contexts(r, i) for node, bit in plain_spelling(code, r, i))
    monkeypatch.setattr(lm_score, "LEAST_BITS", lm_score.MAX_BITS)  # few contexts share a slot
    for group in (64, 0):  # blocks summed in one level, and in two
        monkeypatch.setattr(lm_score, "GROUP", group or 1)
        got = {r["doc_id"]: r for r in lm_score.score_texts(docs.repartition(5), "doc_id % 3 <> 0").collect()}
        for k, r in enumerate(raw):
            assert got[k]["score"] == pytest.approx(-plain_bits(code, counts, r) * math.log10(2), rel=1e-2)  # a few contexts share a slot
            assert got[k]["bits_per_byte"] == pytest.approx(-got[k]["score"] / math.log10(2) / len(r))


def test_numbers_beyond_a_packed_tally():
    keys, n = np.array([5, 9], np.uint64), np.array([3, (1 << lm_score.PACKED) * 5 + 7])
    k, m = lm_score._sum([lm_score._packed(keys, n), lm_score._packed(keys[1:], n[1:])])
    assert k.tolist() == [5, 9] and m.tolist() == [3, 2 * n[1]]


def test_mixing_is_a_distribution():
    """A score depends on nothing after its byte: probabilities of all next bytes sum to one."""
    rng = np.random.default_rng(1)
    code = lm_score.Code(rng.integers(0, 50, (256, 256)) * (rng.random((256, 256)) < 0.2))
    h = np.arange(1 << 16, dtype=np.uint32)
    tables = [rng.integers(0, 1 << 16, 1 << 16).astype(np.uint32) for _ in range(lm_score.CONTEXTS)]
    model = lm_score.Model(code, tables)
    stem = np.frombuffer(b"some text " * 30, np.uint8)
    for t, ctx in enumerate(lm_score.context_hashes(np.append(stem, np.uint8(0)), np.array([0, len(stem) + 1]))):
        for x in np.concatenate([c ^ code.node for c in ctx[-3:]]):  # entries that are found
            tables[t][x >> 15] = (int(x) & 0xFFFF) << 16 | int(h[int(x) % 5000])
    total, before = 0.0, model.bits(stem.copy(), np.array([0, len(stem)]))[0]
    for last in range(256):
        b = np.append(stem, np.uint8(last))
        total += 2.0 ** -(model.bits(b, np.array([0, len(b)]))[0] - before)
    assert total == pytest.approx(1, abs=1e-3)


def test_op2_query(spark, sf):
    """Counts and base by brute force; held-out texts score better than the base does, all in all."""
    got = lm_score.op2_context_mixing(spark, sf).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    assert len(got) == len(docs)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.index}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs.items()}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in count for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
    assert got.score[got.held_out].sum() > 1.15 * got.base_score[got.held_out].sum()


# --- 3 -----------------------------------------------------------------------------------------


def test_page_blocks():
    page = """<html><head><title>no</title><style>p{}</style></head><body><header>Site</header><nav><a>menu</a></nav><div class="cookie-notice">eat</div>
    <article><h1>Head &amp; tail</h1><p>One  <b>two</b><br>three<p>Four&nbsp;&#233;<script>var t="</p>";</script><form>mail</form><div id="comments"><p>rant</p></div><ul><li>a<li>b</ul></article>
    <aside>side</aside><footer>&copy;</footer></body></html>"""
    texts, states = html_text.page_blocks(page)
    assert [t for t, s in zip(texts, states, strict=True) if s == html_text.MAIN] == ["Head & tail", "One two three", "Four é", "a", "b"]


def plain_main_texts(pages):
    """Texts by the definition: every run of RUN tokens outside of articles, page by page of a host."""
    read, where = [], {}
    for url, page in pages:
        host = re.match(html_text.HOST, url or "")
        texts, states = html_text.page_blocks(page)
        stream = [w for t, s in zip(texts, states, strict=True) if s != html_text.MAIN for w in t.split()]
        runs = [tuple(stream[i : i + html_text.RUN]) for i in range(max(1, len(stream) - html_text.RUN + 1))] if stream else []
        read.append((host[1].lower() if host else "", texts, states, len(stream), runs))
        for r in runs:
            where.setdefault((read[-1][0], r), set()).add(tuple(texts))
    out = []
    for host, texts, states, n, runs in read:
        covered = {j for i, r in enumerate(runs) if len(where[host, r]) > 1 for j in range(i, min(n, i + html_text.RUN))}
        keep, at = [], 0
        for t, s in zip(texts, states, strict=True):
            k = len(t.split())
            if s == html_text.MAIN:
                keep.append(t)
                continue
            if s == html_text.FREE and len(covered & set(range(at, at + k))) < html_text.COVERED * k:
                keep.append(t)
            at += k
        out.append("\n\n".join(keep))
    return out


def test_main_texts_brute(spark, monkeypatch):
    r, pages = random.Random(4), []
    shared = [words(n, 500 + n) for n in (3, 9, 14, 30, 60)]
    for i in range(90):
        parts = [r.choice(shared) if r.random() < 0.5 else words(r.randrange(1, 25), r.randrange(10_000)) for _ in range(r.randrange(1, 8))]
        body = "".join(f"<div>{p}</div>" if r.random() < 0.8 else f"<nav>{p}</nav>" for p in parts)
        article = f"<article><p>{r.choice(shared)}</p><p>{words(20, i)}</p></article>" if r.random() < 0.3 else ""
        pages.append((f"http://h{min(3, r.randrange(8))}.x/{i}", f"<body>{body}{article}</body>"))
    pages += pages[:9]
    want = plain_main_texts(pages)
    rows = [(i, *p) for i, p in enumerate(pages)]
    kind = "page_id long, url string, html string"
    got = {x["page_id"]: x["text"] for x in html_text.main_texts(spark.createDataFrame(rows, kind).repartition(7)).collect()}
    assert [got[i] for i in range(len(rows))] == want
    monkeypatch.setattr(html_text, "SALTS", 1)  # the deal of the join doesn't matter
    got = {x["page_id"]: x["text"] for x in html_text.main_texts(spark.createDataFrame(rows, kind)).collect()}
    assert [got[i] for i in range(len(rows))] == want
    alone = [html_text.page_blocks(p) for _, p in pages]
    unjudged = ["\n\n".join(t for t, s in zip(*x, strict=True) if s != html_text.REGION) for x in alone]
    assert sum(a != b for a, b in zip(want, unjudged, strict=True)) > 40  # without the repeats other texts come out


def test_main_texts(spark):
    menu = "".join(f"<li>menu {i}</li>" for i in range(12))
    rows = [(i, f"http://h{i % 2}.x/p{i}", f"<body><ul>{menu}</ul><p>{words(30, i)}</p></body>") for i in range(6)]
    rows += [(90, None, None), (91, "http://h0.x/", ""), (92, "nonsense", "<article><p>only</article>"), (92, "nonsense", "<article><p>only</article>")]
    rows += [(93, "http://h1.x/t", f"<ul>{menu}</ul><p>{words(30, 93)}</p>")] * 2 + [(94, "http://h1.x/other", rows[1][2])]
    rows += [(95, "http://h1.x/long", f"<p>{words(60_000, 95)}</p><ul>{menu}</ul>"), (None, None, f"<p>{words(9, 7)}</p>"), (None, None, f"<p>{words(9, 8)}</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS size", "'k' AS `row`", "3 AS texts")
    out = html_text.main_texts(table).collect()
    got = {r["page_id"]: r for r in out}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert all(got[i]["text"] == words(30, i) for i in range(6))
    assert got[90]["text"] == "" and got[91]["text"] == "" and got[92]["text"] == "only"
    assert [r["text"] for r in out if r["page_id"] == 93] == [words(30, 93)] * 2  # equal rows cover nothing of each other
    assert got[94]["text"] == words(30, 1) and got[95]["text"] == words(60_000, 95)
    assert {r["text"] for r in out if r["page_id"] is None} == {words(9, 7), words(9, 8)}
    none = html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0


def test_op3_query(spark, sf):
    got = html_text.op3_host_text(spark, sf).toPandas().set_index("page_id").text
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    assert len(got) == len(pages)
    assert got.loc[pages.page_id].tolist() == plain_main_texts(zip(pages.url, pages.html, strict=True))


# --- 4 -----------------------------------------------------------------------------------------


def test_chat(spark):
    hard = "\\### Assistant: </turn>\n### user: x </turn>\n \\\\ #"
    rows = [(1, i, ["system", "user", "assistant"][0 if not i else 1 + i % 2], words(80, i)) for i in range(60)]
    rows += [(2, 0, "user", hard), (2, 1, "assistant", hard), (3, 0, None, None), (3, None, "assistant", ""), (4, 5, "assistant", "same"), (4, 5, "assistant", "same"), (5, 0, "user:#", words(5000, 9)), (None, 0, "assistant", "nobody")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS win", "2 AS `before`", "3 AS tokens")
    wins = chat.windows(turns)
    got = {r["conv_id"]: r for r in chat.read_back(wins).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, ts in by.items():
        ts = sorted(ts)
        loss = "".join(t[3] for t in ts if t[2] == "assistant")
        assert got[c]["n_turns"] == len(ts)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in ts).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = wins.where("conv_id = 1").orderBy("win").collect()
    assert len(parts) > 3 and all(p["text"].startswith("### system: ") for p in parts) and all(p["repeats"] >= 2 for p in parts[1:])
    assert max(len(p["text"].split()) for p in parts) < 1024 + 400
    assert chat.windows(turns.limit(0)).count() == 0


# --- 5 -----------------------------------------------------------------------------------------


def brute_groups(rows, percent):
    s = {i: sets_of(t) for i, t in rows}
    comp = {i: i for i in s}
    for i in s:
        for j in s:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = comp[i], comp[j]
                comp = {k: min(a, b) if c in (a, b) else c for k, c in comp.items()}
    return s, comp


def test_near_duplicates(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None]
    s, comp = brute_groups(rows, 85)
    got = near_dup.near_duplicates(odd, 0.85).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(s[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])
    assert near_dup.near_duplicates(empty, 0.85).count() == 0


def test_large_regions_meet_in_blocks(spark, monkeypatch):
    """Many texts of one template whose similarity lies just below and above the threshold: every link is found."""
    r, rows = random.Random(11), []
    base = words(120, 70).split()
    for i in range(160):
        w = list(base)
        for k in r.sample(range(24), 4 if i % 3 else 2):
            w[5 * k] = f"edit{i % 40}x{k}"
        rows.append((i, " ".join(w)))
    _, comp = brute_groups(rows, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1024, 16):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(docs.repartition(3), 0.85).collect()}
        assert got == comp


def test_neighbours_in_sorted_order(spark):
    """The nearest neighbour and the inner region of each label, against a walk over the sorted labels."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 3, (900, near_dup.LABEL)).astype(">u2")
    values = values[np.lexsort(values.T[::-1])]
    pair = values.view(">i8").astype(np.int64)
    depth, n = 2, len(values)
    lcp = [0] + [int(np.logical_and.accumulate(a == b).sum()) for a, b in zip(values, values[1:], strict=False)]
    region = np.cumsum([x < depth for x in lcp])
    ids = rng.permutation(n).astype(np.int64)
    cols = [region, np.zeros(n, np.int64), pair[:, 0].copy(), pair[:, 1].copy(), ids, np.full(n, 50), np.zeros(n, np.int64), np.zeros(n, np.int64)]
    import pyarrow as pa

    names = ["region", "tree", "high", "low", "id", "n", "b0", "b1"]
    rows = pa.record_batch([pa.array(c) for c in cols], names)
    out = pa.Table.from_batches(list(near_dup._neighbours(depth, 80)(iter([rows.slice(0, 300), rows.slice(300)])))).to_pydict()
    place = {int(i): k for k, i in enumerate(ids)}
    crowds = {}
    for i, mate, common, inner in zip(out["id"], out["mate"], out["common"], out["inner"], strict=True):
        k = place[i]
        best = max(lcp[k], lcp[k + 1] if k + 1 < n else 0)
        assert common == (best if best >= depth else 0)
        if mate is not None:
            assert abs(place[mate] - k) == 1 and lcp[max(k, place[mate])] == best
        crowds.setdefault(inner, set()).add(i)
    full = {d: Counter(tuple(v[:d]) for v in values.tolist()) for d in range(depth, near_dup.LABEL + 1)}
    for members in crowds.values():
        d = next((d for d in range(depth, near_dup.LABEL) if full[d][tuple(values[place[min(members)]][:d].tolist())] <= near_dup.CROWD), near_dup.LABEL)
        assert len({tuple(values[place[i]][:d].tolist()) for i in members}) == 1


def test_op5_query(spark, sf):
    got = near_dup.op5_near_dup(spark, sf).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    s, comp = brute_groups(list(zip(docs.doc_id, docs.text, strict=True)), 85)
    assert len(got) == len(docs) and all((got.n_shingles[i], got.component_id[i], got.kept[i]) == (len(s[i]), comp[i], comp[i] == i) for i in docs.doc_id)


def test_near_duplicate_family(spark):
    r, rows = random.Random(5), []
    base = words(150, 7).split()
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"edit{i}x{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    s, comp = brute_groups(rows, 85)
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()}
    assert got == comp and len(set(comp.values())) > 3


# --- 6 -----------------------------------------------------------------------------------------


def test_containment(spark, odd, empty):
    long = words(20000, 3).split()
    items = [(1, " ".join(long[100:112])), (2, " ".join(long[5000:5100])), (3, words(60, 99)), (4, None), (5, ""), (6, "just two"), (7, "JUST TWO"), (8, " ".join(long[300:340]).replace(long[310], "other")), (9, words(60, 1)), (1, words(40, 2))]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS n_found")
    want = set()
    for r in odd.collect():
        for i, t in items:
            q, doc = sets_of(t), sets_of(r["text"])
            if q and 100 * len(q & doc) >= 80 * len(q):
                want.add((r["doc_id"], i, len(q), len(q & doc)))
    got = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in decontaminate.contained_items(odd, bench).collect()}
    assert got == want and len(want) > 6
    assert decontaminate.contained_items(empty, bench).count() == 0
    assert decontaminate.contained_items(odd, bench.limit(0)).count() == 0


# --- 7 -----------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(120):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 4)):
                rows.append((i, (centre + rng.normal(size=16) * 0.05).astype(np.float32).tolist(), label))
                i += 1
    rows += [(i, None, 0), (i + 1, [0.0] * 16, 0), (i + 2, [float("nan")] * 16, 0), (i + 3, [], 0), (i + 4, rows[0][1], 0), (i + 5, rows[0][1], 0), (i + 6, [*rows[0][1][:-1], None], 0), (i + 7, rows[0][1][:8], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS m", "3 AS shard", "4 AS links")
    good = {r[0]: np.array(r[1], float) for r in rows if r[2] is not None and r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    label = {r[0]: r[2] for r in rows}
    links, comp = dict.fromkeys(label, 0), {k: k for k in label}
    unit = {k: v / np.sqrt((v * v).sum()) for k, v in good.items()}
    for a in good:
        for b in good:
            if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                x, y = comp[a], comp[b]
                comp = {k: min(x, y) if c in (x, y) else c for k, c in comp.items()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(df).collect()}
    assert got == {k: (links[k], comp[k], comp[k] == k) for k in label}
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_links_across_shards(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARD", 16)
    x = np.random.default_rng(5).normal(size=(500, 3))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & ~np.eye(500, dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(df).collect()}
    assert [got[i] for i in range(500)] == near.sum(1).tolist()


def test_repeated_ids_of_different_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [0.0, 1.0, 0.01], 0), (3, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "5 AS cls", "6 AS name", "7 AS asked")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(df).collect() if r["vec_id"])
    assert got == [(1, 0, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_links_and_recall_over_many_shards(spark, monkeypatch):
    """Several labels, shards and blocks: links equal brute force, and the audit measures them."""
    monkeypatch.setattr(vector_dedup, "SHARD", 64)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 4))
    label = rng.integers(0, 2, 3000) * (rng.random(3000) < 0.3)
    df = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(3000, dtype=bool)
    found = vector_dedup.near_vectors(df)
    got = {r["vec_id"]: r["n_links"] for r in found.collect()}
    assert sum(got[i] == n for i, n in enumerate(near.sum(1).tolist())) >= 2990
    assert vector_dedup.audit_links(df, found) >= 0.99
    from pyspark.sql import functions as F

    half = found.withColumn("n_links", F.floor(F.col("n_links") / 2))
    assert 0.3 < vector_dedup.audit_links(df, half) < 0.6


def test_op7_query(spark, sf):
    got = vector_dedup.op7_vector_dedup(spark, sf).toPandas().set_index("vec_id")
    t = pd.read_parquet(f"{sf}/embeddings.parquet")
    x = np.array(t.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (t.label.to_numpy()[:, None] == t.label.to_numpy()[None]) & ~np.eye(len(t), dtype=bool)
    assert (got.n_links.loc[t.vec_id].to_numpy() == near.sum(1)).all() and len(got) == len(t)


def test_graph_search_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x = np.concatenate([x, x[:300] + rng.normal(size=(300, 32)) * 0.03]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, medoids = vector_dedup.build_graph(x)
    a, b = vector_dedup.range_search(x[:400], x, graph, medoids, 0.98, 64)
    truth = {tuple(p) for p in np.argwhere(x[:400] @ x.T >= 0.98).tolist()}
    assert len(truth & set(zip(a.tolist(), b.tolist(), strict=True))) >= 0.9 * len(truth)


# --- 8 -----------------------------------------------------------------------------------------


def test_mix(spark, odd, empty):
    plan = mixing.plan_mix(odd).collect()
    rows = odd.select("doc_id", "source", "text").collect()
    assert sum(r["rows"] for r in plan) == len(rows)
    size = {r["source"]: 0 for r in rows}
    for r in rows:
        size[r["source"]] += len((r["text"] or "").encode().split())
    names = sorted(k for k in size if k is not None) + [None]
    weight = {k: [1, 2, 3][i % 3] for i, k in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[k] for k in capped)
        free = sum(weight[k] for k in names if k not in capped)
        want = {k: 3.0 * size[k] if k in capped else left * weight[k] / free for k in names}
        over = {k for k in names if k not in capped and want[k] > 3 * size[k]}
        if not over:
            break
        capped |= over
    for r in plan:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["copies"] <= 3
        assert len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["rows"] * r["copies"] for r in plan)
    assert [tuple(r) for r in mixing.plan_mix(odd).orderBy("doc_id", "size").collect()] == [tuple(r) for r in mixing.plan_mix(odd.repartition(3)).orderBy("doc_id", "size").collect()]
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_op8_query(spark, sf):
    """Targets, what is taken, and the training order, against the definition on a whole table."""
    got = mixing.op8_curriculum_mix(spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    size = docs.set_index("doc_id").text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    assert sorted(got.doc_id) == sorted(docs.doc_id) and (got.set_index("doc_id")["size"] == size.loc[got.doc_id].to_numpy()).all()
    got["source"] = docs.set_index("doc_id").source.loc[got.doc_id].to_numpy()
    total = size.sum()
    assert got.taken.sum() == pytest.approx(total, rel=0.02) and (got.taken <= 3 * got["size"]).all()
    for _, part in got.groupby("source", dropna=False):
        assert part["size"].sum() == part.source_size.iloc[0] and part.taken.sum() == pytest.approx(part.target.iloc[0], rel=0.02, abs=200)
    assert (got.positions.map(len) * got["size"] == got.taken).all()
    copies = sorted((p, i, n, s) for i, n, ps, ss in zip(got.doc_id, got["size"], got.positions, got.starts, strict=True) for p, s in zip(ps, ss, strict=True))
    at = 0
    for _, _, n, start in copies:  # the stream by position holds each copy where the one before ends
        assert start == at
        at += n
    names = sorted(docs.source.dropna().unique(), key=lambda x: x.encode()) + [None]
    checked = 0
    for k, name in enumerate(names):
        part = got[got.source.isna()] if name is None else got[got.source == name]
        times = [(p, n) for n, ps in zip(part["size"], part.positions, strict=True) for p in ps]
        words_ = sum(n for _, n in times)
        if words_ > 3000:  # words taken by half time follow the schedule's integral
            knots = mixing.SCHEDULES[k % 3]
            grid = np.linspace(0, 1, 2001)
            area = np.interp(grid, *zip(*knots, strict=True)).cumsum()
            early = sum(n for p, n in times if p < 0.5) / words_
            assert abs(early - area[1000] / area[-1]) < 0.01 + max(n for _, n in times) / words_
            checked += 1
    assert checked > 1


def test_mix_of_ties_and_odd_rows(spark):
    rows = [(5, "a b", "s")] * 3 + [(5, "a b c", "s"), (5, "a b", None), (None, "x y z", "s"), (None, "x y z", "s"), (6, None, "t"), (7, "", "t"), (8, "w " * 50_000, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS part", "2 AS size", "3 AS copies", "'x' AS src", "4 AS positions")
    order = mixing.training_order(mixing.plan_mix(docs)).collect()
    assert sum(r["rows"] for r in order) == len(rows)
    taken = sum(r["rows"] * r["copies"] * r["size"] for r in order)
    starts = sorted((s, r["rows"] * r["size"]) for r in order for s in r["starts"])
    assert sum(n for _, n in starts) == taken and all(a + n <= b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["rows"] * r["copies"] for r in order)


def test_schedules_invert(spark):
    from pyspark.sql import functions as F

    for knots in (*mixing.SCHEDULES, ((0.0, 2.0), (0.3, 0.0), (0.6, 0.0), (1.0, 1.0))):
        rows = spark.range(21).select((F.col("id") / 20).alias("u")).select("u", mixing.invert_schedule(F.col("u"), knots).alias("t")).collect()
        grid = np.linspace(0, 1, 20001)
        g = np.interp(grid, *zip(*knots, strict=True))
        area = np.concatenate([[0], np.cumsum((g[1:] + g[:-1]) / 2 * np.diff(grid))])
        for r in rows:
            assert np.interp(r["t"], grid, area) / area[-1] == pytest.approx(r["u"], abs=1e-4)


# --- 9 -----------------------------------------------------------------------------------------


def test_quality(spark, odd, empty):
    docs = [(i, words(50, i) if i % 2 else words(50, i).upper() + "!!") for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS quality")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(0, 150)] + [(160, None, 0), (161, 0, 0), (161, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_on(df.drop("quality"), labels, "doc_id % 5 <> 0")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(df.select("doc_id", "text"), model).collect()}
    assert len(got) == 202 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in range(150, 200)]) >= 0.95
    none = quality.fit_on(df.drop("quality"), labels.limit(0), "true")
    assert {r["score"] for r in quality.score_quality(df.select("doc_id", "text"), none).collect()} == {0.5}
    assert quality.score_quality(empty.select("doc_id", "text"), model).count() == 0


def test_quality_of_odd_rows(spark, odd, monkeypatch):
    """Long, repeated and null-id rows are scored whole; a text too long to learn from leaves the others to learn from."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)] + [(None, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "TEXT_BYTES", 60_000)  # leaves out the text of 20,000 words
    model = quality.fit_on(odd.drop("quality"), labels, "true", sample_bytes=61_000)
    assert np.abs(model.logits).max() > 0
    rows = odd.select("doc_id", "text").collect()
    got = quality.score_quality(odd.select("doc_id", "text"), model).collect()
    assert len(got) == len(rows)
    plain = quality.WordLogits(model.logits)
    for r in got:
        ws = quality.tokens(r["text"])
        z = sum(plain[w] for w in ws) / max(1, len(ws)) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_op9_query(spark, sf):
    """At the scale above ``sf``, whose held-out labels are enough to judge by."""
    sf = sf.replace("sf0.001", "sf0.01")
    got = quality.op9_quality(spark, sf).toPandas().set_index("doc_id")
    docs, labels = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    assert sorted(got.index) == sorted(docs.doc_id) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got.index)
    held = labels[labels.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)]
    assert (got.predicted.loc[held.doc_id].to_numpy() == held.quality.to_numpy()).mean() >= 0.95


def test_quality_reads_whole_words():
    r = random.Random(9)
    head = "".join(r.choice("天地人山水") for _ in range(30))
    tail = ["".join(r.choice(s) for _ in range(60)) for s in ("春夏秋冬", "红黄蓝白") * 60]
    model = quality.Model.fit([head + t for t in tail[:80]], [i % 2 for i in range(80)])
    score = quality.WordLogits(model.logits)
    assert [score[(head + t).encode()] + model.bias > 0 for t in tail[80:]] == [bool(i % 2) for i in range(80, 120)]
    assert all(len(w) <= quality.CACHE_WORD for w in score)
    long = ("ab" * quality.SLICE).encode()
    at, weight = quality.doc_features(long.decode())
    grams = [(b"<" + long + b">")[i : i + k] for k in (3, 4, 5) for i in range(len(long) + 3 - k)]
    assert len(at) == len({quality.zlib.crc32(g) % quality.BUCKETS for g in grams} | {quality.zlib.crc32(long, 1) % quality.BUCKETS}) and abs(weight.sum() - 1) < 1e-5


# --- 10 ----------------------------------------------------------------------------------------


def test_chunks_resist_shifts():
    a = np.frombuffer(words(2000, 6).encode(), np.uint8)
    b = np.concatenate([np.frombuffer(b"inserted at the front ", np.uint8), a])
    cut = lambda x: {x[i:j].tobytes() for i, j in zip([0, *chunk_dedup.chunk_ends(x)], chunk_dedup.chunk_ends(x), strict=False)}
    assert len(cut(a) & cut(b)) >= 0.98 * len(cut(a))
    ends = chunk_dedup.chunk_ends(a)
    assert ends[-1] == len(a) and max(np.diff([0, *ends])) <= chunk_dedup.MOST
    h = chunk_dedup.gear_hashes(a[:100])
    x = 0
    for i, c in enumerate(a[:100].tolist()):
        x = (x * 2 + int(chunk_dedup._GEAR[c])) % (1 << 32)
        assert h[i] == x  # what is older than 32 bytes has left the hash


def test_chunk_dedup(spark, odd, empty):
    shared = words(60, 50)
    rows = [(1, words(100, 51) + " " + shared + " " + words(100, 52)), (2, words(90, 53) + " " + shared + " " + words(10, 54)), (3, words(200, 55)), (4, None), (5, ""), (6, "é" * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS place", "2 AS k1", "3 AS run")
    spans = chunk_dedup.repeated_spans(df).collect()
    assert {(r["doc_id"], tuple(r["first_docs"])) for r in spans} == {(2, (1,))}
    out = {r["doc_id"]: r["text"] for r in chunk_dedup.without_repeats(df).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1] and out[4] is None and out[6] == rows[5][1]
    assert words(90, 53) in out[2] and shared not in out[2] and len(out[2]) < len(rows[1][1]) - 112
    whole = chunk_dedup.without_repeats(odd)
    assert whole.count() == odd.count() and chunk_dedup.repeated_spans(empty).count() == 0


def brute_repeats(rows, run=chunk_dedup.RUN):
    """Bytes of each document in windows of ``run`` bytes that stand in an earlier one."""
    seen, out = {}, {}
    for name, raw in sorted((n, t.encode()) for n, t in rows if t):
        n, hit = min(run, len(raw)), np.zeros(len(raw), bool)
        for i in range(len(raw) - n + 1):
            if seen.setdefault((len(raw) < run, raw[i : i + n]), name) != name:
                hit[i : i + n] = True
        out[name] = hit
    return out


def test_chunk_dedup_of_large_groups(spark, monkeypatch):
    """Many near copies, whose differing windows meet beside the first copy or over several parts."""
    r, base = random.Random(12), words(90, 77).split()
    edits = [(k, f"edit{k}x{v}") for k in range(5, 85, 9) for v in range(3)]
    rows = []
    for i in range(24):
        w = list(base)
        for k, e in r.sample(edits, 4):
            w[k] = e
        rows.append((100 + i, words(r.randrange(1, 9), i) + " " + " ".join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (90, " ".join(base[40:70]) * 3)]
    truth = brute_repeats(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (1024, 5):
        monkeypatch.setattr(chunk_dedup, "PART", part)
        got = {n: np.zeros(len(t.encode()), bool) for n, t in rows}
        for s in chunk_dedup.repeated_spans(df).collect():
            got[s["doc_id"]][s["begin"] : s["stop"]] = True
        assert {n for n in truth if (truth[n] != got[n]).any()} == set()


def test_chunk_dedup_finds_whole_repeats(spark):
    r = random.Random(8)
    rows = [(1, words(70, 60))]
    for i in range(60):
        passage = words(r.randrange(26, 60), 100 + i)
        rows += [(10 * i + 10 + k, words(30, 1000 + 10 * i + k) + " " + passage[k:] + " " + words(20, 2000 + 10 * i + k)) for k in range(2)]
    base = words(40, 61)
    rows += [(2000, "Q" + base[:60] + words(30, 62)), (2001, words(30, 63) + base + words(30, 64)), (2002, words(20, 65) + base), (2003, "short copy"), (2004, "short copy"), (2005, "x" * 500), (2006, "y" + "x" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {n: np.zeros(len(t.encode()), bool) for n, t in rows}
    for s in chunk_dedup.repeated_spans(df).collect():
        got[s["doc_id"]][s["begin"] : s["stop"]] = True
        assert all(f < s["doc_id"] for f in s["first_docs"])
    truth = brute_repeats(rows)
    assert sum(h.any() for h in truth.values()) >= 60
    assert {n for n in truth if (truth[n] != got[n]).any()} == set()
    accents = spark.createDataFrame([(1, "é" + "ü" * 200 + "è"), (2, "ê" + "ü" * 200 + "ë")], "doc_id long, text string")
    assert [x["text"] for x in chunk_dedup.without_repeats(accents).orderBy("doc_id").collect()] == ["é" + "ü" * 200 + "è", "êë"]


def test_shingle_slices_hold_little_memory():
    import tracemalloc

    import pyarrow as pa

    from lumenframe.llm import textkit

    texts = pa.array([f"{' '.join(str(i * k) for i in range(3000))}" for k in range(1, 180)])
    assert texts.nbytes > 3 << 20
    textkit._powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    tracemalloc.start()
    for _ in textkit.shingled(texts):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20


def test_chunk_dedup_windows_of_equal_occurrences_go_out_once(spark, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(chunk_dedup, "PART", 50)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    text = " ".join(word() for _ in range(60))
    first = text[:200] + "#" + text[201:]  # all others differ from the first and equal each other
    rows = [(0, first), *((i, text + str(i)) for i in range(1, 301))]
    staged = []
    held = chunk_dedup.Staged
    monkeypatch.setattr(chunk_dedup, "Staged", lambda df, name: staged.append(held(df, name)) or staged[-1])
    got = {}
    for s in chunk_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(s["doc_id"], set()).update(range(s["begin"], s["stop"]))
    assert got == {k: set(np.flatnonzero(v).tolist()) for k, v in brute_repeats(rows).items() if v.any()}
    assert staged[0].df.where("x is not null").count() < 5000


def test_pieces_break_at_punctuation_and_long_ones_are_not_kept():
    """Ids equal the library's around all marks and letters; pieces of equal words share one entry."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, coder, r = Tokenizer.from_file(path), token_shards.Encoder(Tokenizer.from_file(path)), random.Random(5)
    marks = [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "'s", "'ll", "é", "ß", "×", "÷", "ÿ", "…", "́", "ñ.", "<|endoftext|>", "Ω", "字", "7", " ", "\n", "ab", "Zz", "x" * 30]
    texts = ["".join(r.choices(marks, k=r.randrange(1, 30))) for _ in range(3000)] + ["word, word. word; word", "a" * 24, "a" * 25, "a" * 5000, "", None]
    for lo in range(0, len(texts), 500):
        ids, counts = coder.encode(pa.array(texts[lo : lo + 500], pa.string()))
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts[lo : lo + 500]]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    few = token_shards.Encoder(Tokenizer.from_file(path))
    few.encode(pa.array(["so far, so good", "it is so. " + "y" * 99]))
    n = len(few.known)
    few.encode(pa.array(["so, so good; so far... " + "y" * 98, "it: so"]))
    assert len(few.known) == n + 3  # the marks that are new; words are known whatever follows them, and long pieces aren't kept


def test_chunk_dedup_gives_an_occurrence_its_class_once(spark, monkeypatch):
    """Windows that stand first in many documents don't multiply the occurrences of a class."""
    rng = random.Random(21)
    monkeypatch.setattr(chunk_dedup, "PART", 40)
    base = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(30)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in rng.sample(range(30), 2):
            w[k] = w[k][:3] + rng.choice("XY") + w[k][4:]
        rows.append((i, " ".join(w)))
    staged = []
    held = chunk_dedup.Staged
    monkeypatch.setattr(chunk_dedup, "Staged", lambda df, name: staged.append(held(df, name)) or staged[-1])
    got = {}
    for s in chunk_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(s["doc_id"], set()).update(range(s["begin"], s["stop"]))
    assert got == {k: set(np.flatnonzero(v).tolist()) for k, v in brute_repeats(rows).items() if v.any()}
    members = staged[0].df.where("x is null and cx is not null").count()
    late = chunk_dedup._class_spans(staged[0].df, False)
    made = late.selectExpr("count(*) AS n", "sum(size(sources)) AS firsts").first()
    assert 0 < made["n"] <= members < made["firsts"]  # a row for each of them would be more rows than occurrences


@pytest.mark.parametrize("inside", [False, True])
def test_chunk_dedup_lists_the_occurrences_of_a_class(spark, monkeypatch, inside):
    """A line that documents repeat over and over makes a row for each list and each run of spans, not for each occurrence."""
    monkeypatch.setattr(chunk_dedup, "PART", 20)
    line = words(40, 83)[:90] + "\n"
    rows = [(i, words(20, 4000 + i) + "\n" + line * (40 + i % 9) + words(5, 5000 + i) + "\n" + line * (i % 4)) for i in range(100)]
    staged, held = [], chunk_dedup.Staged
    monkeypatch.setattr(chunk_dedup, "Staged", lambda df, name: staged.append(held(df, name)) or staged[-1])
    got = {}
    for s in chunk_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), inside=inside).collect():
        got.setdefault(s["doc_id"], set()).update(range(s["begin"], s["stop"]))
    truth = {k: set(np.flatnonzero(v).tolist()) for k, v in brute_repeats(rows).items() if v.any()}
    if inside:  # more windows repeat text of the same document
        assert all(truth[k] <= got[k] for k in truth)
    else:
        assert got == truth
    members = staged[0].df.where("x is null and cx is not null")
    lists = members.select("cx", "cy", "doc_id", "low").coalesce(1).mapInArrow(chunk_dedup._packer, chunk_dedup.PACKED)
    back = [(p["cx"], p["cy"], d, low + s * i) for p in lists.collect() for d, low, s, n in zip(p["docs"], p["lows"], p["steps"], p["times"], strict=True) for i in range(n)]
    assert sorted(back) == sorted(members.select("cx", "cy", "doc_id", "low").collect())
    assert lists.count() == members.select("cx", "cy").distinct().count() < len(back) / 5
    assert chunk_dedup._class_spans(staged[0].df, inside).count() < len(back) / 2


def test_contexts_are_hashed_in_pieces(monkeypatch):
    """Many texts are hashed a few at a time, one long text whole, to the same predictions as all at once."""
    import pyarrow as pa

    from lumenframe.llm import textkit

    data, offsets = textkit.text_buffers(pa.array([words(n, k) for k, n in enumerate((30, 900, 0, 90, 200, 41) * 4)]))
    b, at = lm_score.byte_stream(data, offsets)
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs, (b[:-1], b[1:]), 1)
    rng = np.random.default_rng(5)
    model = lm_score.Model(lm_score.Code(pairs), [rng.integers(0, 1 << 16, 1 << 18, dtype=np.uint32) for _ in range(lm_score.CONTEXTS)])
    monkeypatch.setattr(lm_score, "PIECE", len(b))
    whole, hashed, plain = model.predict(b, at), [], lm_score.context_hashes
    monkeypatch.setattr(lm_score, "PIECE", 2000)
    monkeypatch.setattr(lm_score, "context_hashes", lambda b, at: hashed.append((len(b), len(at) - 1)) or plain(b, at))
    assert all((x == y).all() for x, y in zip(model.predict(b, at), whole, strict=True))
    assert sum(n for n, _ in hashed) == len(b) and sum(k for _, k in hashed) == len(at) - 1
    assert all(n <= 2000 or k == 1 for n, k in hashed)


def test_scores_do_not_depend_on_blocks(monkeypatch):
    """Predictions made block by block, and contexts hashed slice by slice, give the same numbers."""
    import pyarrow as pa

    from lumenframe.llm import textkit

    texts = pa.array([words(n, k) for k, n in enumerate((3, 400, 0, 90, 1500, 41))] + ["", None, "é ñ", "zz" * 700])
    data, offsets = textkit.text_buffers(texts)
    b, at = lm_score.byte_stream(data, offsets)
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs, (b[:-1], b[1:]), 1)
    code, rng = lm_score.Code(pairs), np.random.default_rng(3)
    model = lm_score.Model(code, [rng.integers(0, 1 << 32, 1 << 18, dtype=np.uint32) for _ in range(lm_score.CONTEXTS)])
    for table, context in zip(model.tables, lm_score.context_hashes(b, at), strict=True):  # some entries that are found
        h = np.repeat(context, code.spell(code.symbols(b, at))[1]) ^ code.node[code.spell(code.symbols(b, at))[0]]
        table[h >> 13] = ((h & 0xFFFF) << 16) | rng.integers(0, 1 << 16, len(h), dtype=np.uint32)
    whole, size = model.predict(b, at), []
    for block in (7, 1000):
        monkeypatch.setattr(lm_score, "BLOCK", block)
        assert all((x == y).all() for x, y in zip(model.predict(b, at), whole, strict=True))
    for i in range(len(at) - 1):
        size.append(model.bits(b[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))[0])
    assert model.bits(b, at).tolist() == pytest.approx(size, rel=1e-6)
