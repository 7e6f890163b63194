"""Every operator against a plain rendering of its contract on small fixtures, and the odd inputs."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from switchyard.llm import bpe, chunks, divergence, kdshard, packing, parsing, simhash, toxicity, urlmodel, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_words long, shard string, fingerprint int, spans string, key int"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "sun", "é", "ö"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Nulls, empty and blank texts, repeated rows, copies, a very long text, names that clash."""
    rng = random.Random(5)
    long = sentence(rng, 40_000)
    texts = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (4, "one"),
        (None, "no id here, but words"),
        (None, None),
        (7, long),
        (8, long),
        (9, sentence(rng, 120) + "\n\n  two  spaces \n"),
        (10, "the the the the the " * 30),
        (11, "日本語の文章です。" * 40),
        (12, "ends with a space "),
        (13, "line\n \nbreaks <|endoftext|> don't 'S"),
    ]
    return [(i, t, "en" if k % 3 else None, "s", k, "x", k, "y", k) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingle_print(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def near_values(rng, n):
    """Clusters of 64-bit values within a few bits, and strangers."""
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.randint(0, 12)):
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out, key=lambda v: hash((v, 1)))[:n]


@pytest.mark.parametrize("shard", [4096, 5])
def test_fingerprint_links_connect_what_is_near(spark, monkeypatch, shard):
    """Also when every shard is dealt into cells."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    values = near_values(random.Random(1), 300)
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fingerprint long, rep long"), 4)
    found = {r.id: r.component for r in simhash.components(links).collect()}
    want = grouped(range(len(values)), lambda a, b: (values[a] ^ values[b]).bit_count() <= 4)
    assert {i: found.get(i, i) for i in want} == want


def test_tree_prunes_only_connected_parts():
    rng = random.Random(2)
    values = near_values(rng, 400) + [v ^ (1 << b) for v in [rng.getrandbits(64)] for b in range(64)]
    tree = simhash._Tree(4)
    links = [(i, j) for i, v in enumerate(values) for j in tree.add(v)]
    own = {frozenset(p) for p in links}
    want = grouped(range(len(values)), lambda a, b: (values[a] ^ values[b]).bit_count() <= 4)
    assert grouped(range(len(values)), lambda a, b: frozenset((a, b)) in own) == want


def test_near_groups_of_odd_texts(odd, none):
    rows = simhash.near_groups(odd, shingle=4).collect()
    texts = {r[0]: r[1] for r in odd_rows()}
    assert len(rows) == len(odd_rows())
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.fingerprint == f"{shingle_print(texts[r.doc_id]):016x}"
    parts = {r.doc_id: r.component_id for r in rows}
    assert parts[1] == parts[2] == parts[3] == 1 and parts[7] == parts[8] == 7 and parts[9] == 9
    assert simhash.near_groups(none).count() == 0


def test_linked_documents_leave_one(spark):
    rng = random.Random(3)
    rows = []
    for i in range(0, 60, 3):
        words = sentence(rng, 400).split()
        rows += [(i, " ".join(words), 1), (i + 1, " ".join([*words[:200], f"new{i}", *words[200:]]), 1), (i + 2, sentence(rng, 200), 1)]
    # A repeated row, an id with another text, a row without an id.
    rows += [(0, rows[0][1], 1), (5, sentence(rng, 90), 1), (5, rows[0][1], 1), (None, rows[0][1], 1)]
    kept = simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, component long")).collect()
    known = [(i, t) for i, t, _ in rows if i is not None]
    prints = [shingle_print(t) for _, t in known]
    groups = grouped(range(len(known)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = {min((known[m] for m in groups if groups[m] == g), key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest())) for g in groups.values()}
    assert len(want) < len(set(known)) - 10
    assert sorted(tuple(r)[:2] for r in kept if r.doc_id is not None) == sorted(want)
    assert [r.text for r in kept if r.doc_id is None] == [rows[0][1]]


def shingles(text, width=5):
    words = text.split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


@pytest.mark.parametrize("shard", [4096, 5])
def test_similar_groups_are_exact(spark, monkeypatch, shard):
    """Pairs around 0.8 and a chain of them against brute force, also dealt into cells."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(4)
    texts = []
    for i in range(160):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        cut = 4 + 396 * (70 + i % 21) // 100  # that share of the shingles stays, the others go
        texts += [" ".join(words), " ".join(words[:cut])]
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    texts += [" ".join(words[at : at + 400]) for at in range(0, 500, 35)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    sets = [shingles(t) for t in texts]
    want = grouped(range(len(texts)), lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    assert not [(i, found[i], want[i]) for i in want if found[i] != want[i]]


@pytest.mark.parametrize("times", [1, 5, 8, 19])
def test_repeated_lines_stay_within_the_radius(times):
    rng = random.Random(times)
    for _ in range(50):
        shared = " ".join(f"w{rng.randrange(10**6)}" for _ in range(204))
        line = " ".join(f"v{rng.randrange(10**6)}" for _ in range(6))
        a, b = simhash.outline(shared, 5), simhash.outline(f"{shared}\n" + f"{line}\n" * times, 5)
        assert (a[0] ^ b[0]).bit_count() <= simhash.WIDE_RADIUS


def test_shards(spark, odd, none):
    rng = random.Random(4)
    data = [(i, sentence(rng, rng.randint(1, 60)), "en" if i % 3 else "fr", "hot" if i % 2 else str(i)) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    rows = kdshard.assign(docs, 7).collect()
    texts = {d[0]: d[1].encode() for d in data}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(7)) and max(sizes.values()) < 1.02 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert kdshard.assign(odd, 3).count() == len(odd_rows()) and kdshard.assign(none, 3).count() == 0


def test_slots_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(kdshard, "SLOT_ROWS", 20)
    docs = spark.createDataFrame([(i, "x" * (i % 9), "en", "s") for i in range(500)], "doc_id long, text string, lang string, source string")
    slots = collections.defaultdict(list)
    for r in kdshard.assign(docs, 3).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 500


def test_parsing_next_documents(spark, odd, none):
    rng = random.Random(6)
    data = [(i * 7, sentence(rng, rng.randint(0, 80))) for i in range(60)]
    rows = {r.doc_id: r for r in parsing.compare_with_next(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    order = sorted(data, reverse=True)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].fingerprint == parsing.written(parsing.sketches([text])[0])
        if len(text) > 150:
            assert rows[i].near_edited > rows[i].near_next
    found = parsing.compare_with_next(odd).collect()
    assert len(found) == len(odd_rows())
    same = {r.doc_id: r.fingerprint for r in found}
    assert same[7] == same[8] and same[1] == same[2] == "" and parsing.compare_with_next(none).count() == 0


def test_phrases_do_not_depend_on_offset():
    rng = random.Random(7)
    body = sentence(rng, 300)
    shifted = [parsing.sketches([sentence(random.Random(k), k) + body])[0] for k in range(1, 6)]
    alone = parsing.sketches([body])[0]
    assert min(parsing.likeness(alone, s) for s in shifted) > 0.75
    together = parsing.sketches([body, "", body, sentence(rng, 300)])
    assert (together[0] == alone).all() and (together[2] == alone).all() and len(together[1]) == 0
    assert parsing.likeness(together[0], together[3]) < 0.2 and parsing.likeness(together[1], together[1]) == 1.0


def test_toxicity_learns_marks(spark, odd, none):
    rng = random.Random(8)
    insults = ["dreadfulword", "nastyname", "vilething"]
    data, marks = [], []
    for i in range(900):
        words = sentence(rng, 40).split()
        if i % 3 == 0:
            for at in (5, 15, 25):
                words[at] = rng.choice(insults)
        data.append((i, " ".join(words)))
        marks.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(1, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, toxicity.outside(labels))
    rows = toxicity.score(docs, model, ["doc_id"]).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score(odd, model, ["doc_id", "key"]).count() == len(odd_rows())
    untaught = toxicity.fit(none, labels)
    assert {r.predicted for r in toxicity.score(odd, untaught, ["doc_id"]).collect()} == {0}
    assert toxicity.score(none, model, ["doc_id"]).count() == 0


def test_archives(spark, tmp_path):
    big = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (9, None, big), (1, "u", "short"), (2, "u", "short")]
    rows += [(4, "u", None), (6, "u", ""), (None, "u", big), (3, "http://b/", big), (7, "ü", "é" * 60)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    warc.write_archives(pages, str(tmp_path / "a"))
    found = sorted(warc.read_archives(spark, str(tmp_path / "a")).collect(), key=str)
    assert len(found) == len(rows)
    payload = collections.defaultdict(set)
    for i, _, html in rows:
        payload[i].add((html or "").encode())
    for r in found:
        (data,) = payload[r.page_id]
        again = data == big.encode() and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
        assert r.payload_digest == hashlib.sha256(data).hexdigest() and r.payload_bytes == len(data)
    warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_bpe_equals_the_library(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    encoded = bpe.encode(odd, path, public_tokenizers.PATTERN)
    found = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(encoded, path).collect())
    want = []
    for row in odd_rows():
        text = row[1] or ""
        want.append((row[0] is None, row[0] or 0, np.array(library.encode_ordinary(text), "<u4").tobytes(), text.encode()))
    assert found == sorted(want)
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def url_parts(url):
    _, mark, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest if mark else "")[0]
    path = re.match(r"[^?#]*", rest[len(host) :] if mark else "")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    best = None
    for r in urlmodel.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return best


def test_url_model_against_counting(spark):
    rng = random.Random(9)
    urls = [None, "", "no-scheme.net/x", "HTTP://A.NET", "http://Q.example.net/EN/", "x://y://z"]
    for _ in range(400):
        host = rng.choice(["good", "spam"]) + rng.choice(["a", "b"]) + rng.choice([".net", ".example.net", ".example.com", ".org", ".Io"])
        urls.append(f"http://{host}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(0, 99)}{rng.choice(['', '?q', '#f'])}")
    urls += urls[:50]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    rows = {r.page_id: r for r in urlmodel.judge(pages).collect()}
    assert len(rows) == len(urls)
    n = urlmodel.ORDER
    counts = {k: [collections.Counter() for _ in range(n + 1)] for k in ("allow", "block")}
    lines = collections.Counter("".join(url_parts(u)) for u in urls)
    label = {"".join(p): (rule_of(*p).verdict if rule_of(*p) else None) for p in map(url_parts, urls)}
    grams = {x: [("\x02" * n + x + "\x03")[i : i + n + 1] for i in range(len(x) + 1)] for x in lines}
    for x, times in lines.items():
        if label[x] and zlib.crc32(x.encode()) % 5:
            for g in grams[x]:
                for order in range(n + 1):
                    counts[label[x]][order][g[n - order :]] += times

    def chance(k, g):
        p = 1 / 256
        for order in range(n + 1):
            context = g[n - order : n]
            after = {t: c for t, c in counts[k][order].items() if t[:-1] == context}
            if after:
                p = (after.get(g[n - order :], 0) + len(after) * p) / (sum(after.values()) + len(after))
        return p

    cached = {g: math.log(chance("allow", g)) - math.log(chance("block", g)) for x in grams for g in set(grams[x])}
    score = {x: sum(cached[g] for g in gs) / len(gs) for x, gs in grams.items()}
    limit = max(r.score for r in rows.values() if r.rule is None and r.verdict == "block") if any(
        r.rule is None and r.verdict == "block" for r in rows.values()
    ) else -math.inf
    for i, u in enumerate(urls):
        host, path = url_parts(u)
        rule, r = rule_of(host, path), rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        assert abs(r.score - score[host + path]) < 1e-6
        if rule:
            assert r.verdict == rule.verdict
        else:
            assert r.verdict == ("allow" if host + path == "" or r.score > limit else "block")
    assert urlmodel.judge(pages.limit(0)).count() == 0


def test_packing(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(odd, path).collect()
    texts = collections.Counter((r[0], r[1] or "") for r in odd_rows())
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length
    for doc_id in {i for i, _ in texts}:
        want = collections.Counter()
        for (i, t), n in texts.items():
            if i == doc_id:
                want[np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()] += n
        pieces = by_doc[doc_id]
        if sum(want.values()) == 1:
            (ids,) = want
            joined = b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start))
            assert joined == ids and all(p.doc_tokens == len(ids) // 4 for p in pieces)
        else:
            assert sum(p.length for p in pieces) == sum(len(k) // 4 * n for k, n in want.items())
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces)][:-1]
        total = sum(p.length for p in pieces)
        assert total <= 2048 and total & (total - 1) == 0 and {p.window for p in pieces} == {total}
    assert packing.pack(none, path).count() == 0


def test_texts_cut_at_spaces_keep_their_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(10)
    texts = ["".join(rng.choice([" ", "\n", "a", "bc", "1", "'s", "é", "\u3000", ".", "<|endoftext|>"]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    found = [np.frombuffer(b, "<u4").tolist() for b in packing.encode_texts(texts, path)]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def base_counts(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, none):
    rng = random.Random(11)
    clean = [(100 + i, sentence(rng, 80) + "\n" + sentence(rng, 40)) for i in range(30)]
    junk = [(200, " ".join("@#~!^" for _ in range(30)) + " " + " ".join("(-_-)" + str(i) + "#%" for i in range(60)))]
    more = spark.createDataFrame([(i, t, "en", "s", 0, "x", 0, "y", 0) for i, t in clean + junk], DOCS)
    docs = odd.union(more)
    rows = divergence.assess(docs).collect()
    texts = collections.defaultdict(list)
    for i, t in [(r[0], r[1]) for r in odd_rows()] + clean + junk:
        texts[i].append(t)
    assert len(rows) == sum(map(len, texts.values()))
    for r in rows:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert own in [base_counts(t) for t in texts[r.doc_id]]
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert r.kept == (not r.base_failed and r.char_distance <= divergence.MAX_CHARS and r.word_distance <= divergence.MAX_WORDS)
    verdict = {r.doc_id: r.kept for r in rows}
    assert all(verdict[i] for i, _ in clean) and not verdict[200] and not verdict[10]
    kept = divergence.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    assert divergence.assess(none).count() == 0 and divergence.keep(none).count() == 0


def test_passages_are_cut_once(spark, odd, none):
    rng = random.Random(12)
    passage = sentence(rng, 70)
    own = [sentence(rng, 150) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(own)]
    for i in (3, 5, 8):
        at = 20 + i
        words = own[i].split()
        rows[i] = (i, " ".join(words[:at] + [passage] + words[at:]))
    rows += [(20, own[1]), (21, "inserted words first " + own[2])]
    found = {r.doc_id: r for r in chunks.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert found[3].spans is None and found[3].text == texts[3]
    for i in (5, 8):
        assert len(found[i].text) < len(texts[i]) - len(passage) / 2 and passage not in found[i].text
        assert found[i].spans[0].sources == [3]
        assert len(set(own[i].split()) - set(found[i].text.split())) <= 2
    assert all(found[i].text == texts[i] for i in (0, 1, 2, 4, 6, 7, 9, 10, 11))
    assert len(found[20].text) == 0 and len(found[21].text) < 120
    cut = chunks.deduplicate(odd)
    assert cut.count() == len(odd_rows()) and chunks.deduplicate(none).count() == 0
    by_id = collections.defaultdict(list)
    for r in cut.collect():
        by_id[r.doc_id].append(r.text)
    assert by_id[1] == [None] and by_id[2] == [""] and by_id[8] == [""] and by_id[4] == ["one", "one"]
    assert by_id[7][0].startswith(odd_rows()[7][1][:200])


def test_chunks_tile_each_text():
    rng = random.Random(13)
    texts = [sentence(rng, n).encode() for n in (0, 1, 5, 400)] + ["日本語の文章です。".encode() * 30, b"\0\0 x", b""]
    owner, begin, end, _ = chunks.cut(texts)
    for i, t in enumerate(texts):
        parts = [(b, e) for o, b, e in zip(owner, begin, end, strict=True) if o == i]
        assert [b for b, _ in parts] == [0, *(e for _, e in parts)][: len(parts)]
        assert (parts[-1][1] if parts else 0) == len(t.decode())


def plain_ends(text: bytes) -> list[int]:
    """Ends of a text's chunks, byte by byte from the rule."""
    ends = []
    for i in range(len(text)):
        h = sum(int(chunks._GEAR[text[i - k]]) << k for k in range(min(16, i + 1))) % 2**32 >> 16
        blank = text[i] == 32 or 9 <= text[i] <= 13
        after = text[i + 1] if i + 1 < len(text) else None
        run = len(re.search(rb"[^\x09-\x0d\x20]*$", text[: i + 1])[0])
        if blank and h % chunks.MEAN == 0:
            ends.append(i + 1)
        elif after is not None and after >= 0xE0 and h % chunks.WIDE_MEAN == 0:
            ends.append(i + 1)
        elif run >= chunks.RUN and not blank and (after is None or after & 0xC0 != 0x80) and h % chunks.RUN_MEAN == 0:
            ends.append(i + 1)
    return sorted({*ends, len(text)} - {0})


def test_chunks_equal_a_plain_chunker():
    rng = random.Random(17)
    run = "".join(rng.choice("abcdefgh01234567+/") for _ in range(900))
    texts = [sentence(rng, 150), run, sentence(rng, 9) + " " + run + "é" * 200 + "\n" + run[:63] + " end", "日本語の文章" * 40, "", "x" * 64]
    coded = [t.encode() for t in texts]
    owner, _, end, digest = chunks.cut(coded)
    for i, t in enumerate(coded):
        ends = plain_ends(t)
        assert end[owner == i].tolist() == [len(t[:e].decode()) for e in ends]
        begins = [0, *ends[:-1]]
        expected = [chunks.xxhash.xxh3_64_intdigest(t[b:e]) for b, e in zip(begins, ends)]
        assert digest[owner == i].view("uint64").tolist() == expected


def test_long_runs_share_chunks(spark):
    """One character more in a run without white space leaves the rest of it found."""
    rng = random.Random(19)
    run = "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(5000))
    rows = [(1, run), (2, run[:2500] + "!" + run[2500:]), (3, "data: " + run)]
    found = {r.doc_id: r for r in chunks.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].text == run and len(found[2].text) < 600 and len(found[3].text) < 300


def test_hot_digests_are_dealt_alike(spark, monkeypatch):
    """Spans are the same with every digest dealt into parts, a part, or none."""
    rng = random.Random(23)
    passage = sentence(rng, 80)
    rows = [(i, sentence(rng, 40) + " " + passage + " " + sentence(rng, 40)) for i in range(60)] + [(5, passage), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for share in (1 << 40, 200, 1):
        monkeypatch.setattr(chunks, "HOT", share)
        results.append(sorted((r.doc_id, r.spans) for r in chunks.repeated_spans(df).collect()))
    assert results[0] == results[1] == results[2] and len(results[0]) >= 59
