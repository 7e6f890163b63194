"""Binary records, conversation repair and hard negatives against plain renderings of their contracts."""

import hashlib
import io
import random
import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from switchyard.llm import negatives, packing, records, repair
from switchyard.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- binary records -------------------------------------------------------------------------

TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "a\n\nb\nc d", "\na b", " \n", "x\t y\tz", "a <|endoftext|> b", "a\nb<|endoftext|>\nc",
    "don't 'S\n'll", "日本語 。\n a", "a b 　c", "a.\nB. c, d,\n", "wort " * 3000, "no id",
]


def plain_ids(text):
    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


@pytest.fixture(scope="module")
def written(spark):
    rows = [(i if t != "no id" else None, t, "x", i) for i, t in enumerate(TEXTS)] + [(3, "a", "x", 3), (3, "b", "y", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int").repartition(3)
    path = scratch_path(spark, "test-records")
    records.write_records(docs, path, PATH, file_bytes=200)
    return rows, path


def test_records_come_back_in_order(spark, written):
    rows, path = written
    found = sorted(records.read_records(spark, path).collect(), key=lambda r: r.start)
    wanted = sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    assert [r.doc_id for r in found] == wanted
    at = 0
    for r in found:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    assert sorted(bytes(r.ids) for r in found) == sorted(plain_ids(t) for _, t, *_ in rows)


def test_files_roll_over_and_shuffled_reads_follow_the_index(spark, written):
    _, path = written
    assert records.manifest(spark, path).groupBy("part").count().agg(F.max("count")).first()[0] > 1
    straight = {(r.start, bytes(r.ids)) for r in records.read_records(spark, path).collect()}
    shuffled = records.read_shuffled(spark, path, seed=7).collect()
    assert {(r.start, bytes(r.ids)) for r in shuffled} == straight and len(shuffled) == len(straight)
    other = records.read_shuffled(spark, path, seed=8).collect()
    order = [r.start for r in sorted(shuffled, key=lambda r: r.position)]
    assert order != [r.start for r in sorted(other, key=lambda r: r.position)] and order != sorted(order)
    assert records.index(spark, path).agg(F.sum("n_tokens")).first()[0] == sum(len(i) // 4 for _, i in straight)


def test_damaged_records_are_noticed():
    ids = np.array([1, 70_000, 3], "<u4")
    record = records.frame(9, ids)
    doc_id, found = records.read_frame(io.BytesIO(record))
    assert doc_id == 9 and found.tolist() == ids.tolist()
    assert records.read_frame(io.BytesIO(records.frame(None, ids[:1])))[0] is None
    for at in range(len(record)):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bytes(broken)))
    with pytest.raises(ValueError):
        records.read_frame(io.BytesIO(record[:-1]))


def test_encoder_looks_for_odd_keys_among_new_ones_only(monkeypatch):
    """A known word costs one look-up: no pattern runs over texts to find rare characters."""
    looked = []

    class Odd:
        def search(self, key, own=records._ODD):
            looked.append(key)
            return own.search(key)

    monkeypatch.setattr(records, "_ODD", Odd())
    encoder = records.Encoder(Tokenizer.from_file(PATH))
    text = "some plain words\nand some <|more of them"
    first = list(encoder.encode([text]))
    assert sorted(looked) == sorted(set(looked)) and "<|more" in looked and "plain" in looked
    looked.clear()
    assert list(encoder.encode([text])) == first and not looked


def test_encoder_keeps_its_store_small():
    encoder = records.Encoder(Tokenizer.from_file(PATH), known=50)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(3)) + rng.choice(["", ".", ",\n"]) for _ in range(40)) for _ in range(30)]
    for text in [*TEXTS[1:], *texts]:
        assert next(encoder.encode([text])) + b"\2\0\0\0" == plain_ids(text)
        assert len(encoder.store) < 250
    long = " ".join(texts * 500)
    assert next(encoder.encode([long])) + b"\2\0\0\0" == plain_ids(long)


ODD_TEXTS = ["\tq", "\t", "\n", "\x85_ a", "\x1cBc. d", "a\n\tb", "q***&&& Éß%, ŋª.", "Ж日 ꟊ\U0001e030 a\u0300b", "x<|\ny|> '. 'll"]


def test_encoder_gives_the_ids_of_texts_that_begin_with_any_white_space():
    """A tab in front was taken for a word behind a space."""
    encoder = records.Encoder(Tokenizer.from_file(PATH))
    for some in (ODD_TEXTS, ODD_TEXTS[::-1]):
        assert [ids + b"\2\0\0\0" for ids in encoder.encode(some)] == [plain_ids(t) for t in some]


def test_packing_encodes_a_word_behind_a_line_end_once(monkeypatch):
    """Words beside a line end were learned as one long word for each pair."""
    store, learned = packing._Words(Tokenizer.from_file(PATH)), []
    monkeypatch.setattr(store, "_learn", lambda keys, own=store._learn: (learned.extend(keys), own(keys)))
    list(store.encode(["one.\nTwo one.\nThree four.\nTwo four.\nThree"]))
    assert sorted(learned) == sorted({"\none.", "\nTwo", "\nThree", "one.", "four."})


def test_packing_store_is_small_between_tasks():
    """More different words than the store takes: it stays below a million."""
    store = packing._Words(Tokenizer.from_file(PATH))
    for at in range(0, 1_100_000, 100_000):
        store.ids([f"{n:x}" for n in range(at, at + 100_000)])
    assert len(store.young) + len(store.old) <= 800_000


def test_no_documents_give_no_records(spark):
    path = scratch_path(spark, "test-records")
    records.write_records(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert records.read_records(spark, path).count() == 0 and records.read_shuffled(spark, path).count() == 0


# --- conversation repair --------------------------------------------------------------------


def plain_repair(rows):
    """conv_id -> (gaps, ..., audit, digest); suffixes compared as (cost, audit string)."""
    talks = {}
    for conv, turn, role, text in rows:
        kept = talks.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept.extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for conv, kept in talks.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults, info = set(), [], []
        for _, role, text in kept:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            info.append((role, text, fault in ("blank", "duplicate"), 3 * (fault == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))

        def fits(letter, state):
            return state in {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}.get(letter, ())

        @cache
        def best(at, state, room):
            ways = [(0, "", ())] if at == len(info) and state in ("", "a") else []
            for name in ("user", "assistant") if room else ():
                if fits(name[0], state):
                    cost, audit, said = best(at, name[0], room - 1)
                    ways.append((cost + 3, "I" + audit, (f"{name}:", *said)))
            if at < len(info):
                role, text, gone, more = info[at]
                cost, audit, said = best(at + 1, state, 2)
                ways.append((cost + 4, "D" + audit, said))
                for letter, name, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)) if not gone else ():
                    if fits(name[:1], state):
                        cost, audit, said = best(at + 1, name[:1], 2)
                        ways.append((cost + price + more, letter + audit, (f"{name}:{text}", *said)))
            return min(ways, default=(10**9, "~", ()), key=lambda w: w[:2])

        cost, audit, said = best(0, "", 2)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn int, role string, text string, audit string, cost int, copies int"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(1)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    texts = ["Hi.", "ok", "Yes! ", "", "  ", None, "no?\n", "a b.", "x", "cut off", "fine.", "é。"]
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(rng.randint(0, 9)):
            for _ in range(rng.choice([1, 1, 1, 1, 2])):
                rows.append((conv, rng.choice([turn, turn, turn, None, turn + 1]), rng.choice(roles), rng.choice(texts)))
    for turn in range(200):  # several blocks
        rows.append((1000, turn, rng.choice(roles[:5]), rng.choice(["Hi.", "ok", f"Yes! {turn}.", f"q {turn}", f"w.{turn}!"])))
    return rows


def test_repair(spark, talks):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in talks], CONVERSATIONS).repartition(5)
    found = repair.repair(df)
    assert {r.conv_id: tuple(r)[1:] for r in found.collect()} == plain_repair(talks)


def test_repaired_rows_are_sound(spark, talks):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in talks], CONVERSATIONS)
    rows = repair.damage(df)
    found = repair.audits(repair.facts(rows))
    said, audits = {}, {r.conv_id: r.audit for r in found.collect()}
    for r in sorted(repair.repaired(rows, found).collect(), key=lambda r: r.place):
        said.setdefault(r.conv_id, []).append(r)
    for conv, audit in audits.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in said.get(conv, [])))
        assert len(said.get(conv, [])) == len(audit.replace("D", ""))
    assert repair.repair(df.limit(0)).count() == 0


def test_block_size_decides_nothing(monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(150)]
    answers = set()
    for size in (1, 2, 7, 64, 200):
        monkeypatch.setattr(repair, "BLOCK", size)
        audit = repair.Audit()
        for row in rows:
            audit.add(*row)
        answers.add(audit.least())
    assert len(answers) == 1


# --- hard negatives -------------------------------------------------------------------------


def plain_negatives(rows):
    kept = set()
    for i, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            kept.add((i, tuple(vector), (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
    width = max((len(v) for _, v, _ in kept), default=0)
    whole = [[int(np.floor(256 * x)) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    out = set()
    for k, (i, _, label) in enumerate(kept):
        if i is None or i % 50:
            continue
        score = [max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[k], w)))) for w in whole]
        order = sorted(range(len(kept)), key=lambda r: (-score[r], kept[r][0] is None, kept[r][0] or 0))
        for p in [r for r in order if r != k and kept[r][2] == label][:5]:
            fits = [r for r in order if kept[r][2] != label and 50 * score[p] <= 100 * score[r] <= 95 * score[p]]
            out.update((i, kept[p][0], n + 1, kept[r][0], score[p], score[r]) for n, r in enumerate(fits[:3]))
    return out


def vectors(rng, n):
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(n):
        vector = [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]
        vector = centres[0] if i % 5 == 0 else vector  # one common vector
        vector = vector[:3] if i % 97 == 0 else [float("nan")] * 6 if i % 101 == 0 else None if i % 103 == 0 else vector
        vector = [None, *vector[1:]] if i % 107 == 1 and vector else vector
        rows.append((i if i % 211 else None, vector, rng.choice([0, 1, 2, 3, None])))
    return rows + rows[:40]


EMBEDDINGS = "vec_id long, embedding array<double>, label int, key string, shard string, windows int"


def test_hard_negatives(spark, monkeypatch):
    rows = vectors(random.Random(3), 1200)
    monkeypatch.setattr(negatives, "SHARD_ROWS", 150)
    monkeypatch.setattr(negatives, "CELL_ROWS", 40)
    monkeypatch.setattr(negatives, "SAMPLE", 200)
    df = spark.createDataFrame([(*r, "k", "s", 1) for r in rows], EMBEDDINGS).repartition(5)
    found = [tuple(r) for r in negatives.hard_negatives(df).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_negatives(rows) and found
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_hard_negatives_with_huge_components(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(0.5, 1) * 10.0 ** rng.choice([0, 6, 30]) for _ in range(3)], rng.randint(0, 1)) for i in range(101)]
    df = spark.createDataFrame([(*r, "k", "s", 1) for r in rows], EMBEDDINGS)
    assert {tuple(r) for r in negatives.hard_negatives(df).collect()} == plain_negatives(rows)


def test_walk_falls_and_is_whole():
    rng = np.random.default_rng(2)
    left, right = rng.normal(size=9), rng.normal(size=7)
    steps = list(negatives.walk(left, right))
    sums = [s for s, *_ in steps]
    assert sums == sorted(sums, reverse=True) and len({(i, j) for _, i, j in steps}) == 63
    assert all(s == pytest.approx(left[i] + right[j]) for s, i, j in steps)


def test_search_stops_before_cells_out_of_reach(spark, monkeypatch):
    """Far clusters: an anchor's walk ends after its own cells."""
    rng = random.Random(5)
    rows = [(i, [x * 10 + rng.gauss(0, 0.01) for x in ([1, 0, 1, 0] if i % 2 else [0, 1, 0, 1])], i % 3) for i in range(600)]
    df = spark.createDataFrame([(*r, "k", "s", 1) for r in rows], EMBEDDINGS)
    monkeypatch.setattr(negatives, "SHARD_ROWS", 100)
    monkeypatch.setattr(negatives, "CELL_ROWS", 100)
    index, placed = negatives.build(negatives.clean(df).persist())
    anchors = negatives.clean(df).where("vec_id % 50 = 0").withColumn("windows", F.lit(None).cast("array<long>"))
    sent = negatives._route(anchors, index).groupBy("vec_id").count().agg(F.max("count")).first()[0]
    assert sent < placed.select("shard").distinct().count()
