"""Operators against brute force, on odd rows and on the smallest tables."""

from __future__ import annotations

import hashlib
import random
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from crashgrid.llm import sql  # noqa: E402
from crashgrid.llm.common import stored  # noqa: E402
from crashgrid.llm.fingerprints import differing, fingerprints  # noqa: E402
from crashgrid.llm.language_id import identify, train  # noqa: E402
from crashgrid.llm.minhash import near_duplicates  # noqa: E402
from crashgrid.llm.mixing import mix  # noqa: E402
from crashgrid.llm.packing import pack_windows  # noqa: E402
from crashgrid.llm.quality_rules import quality_rules  # noqa: E402
from crashgrid.llm.queries import QUERIES  # noqa: E402
from crashgrid.llm.substring_dedup import repeated_passages  # noqa: E402
from crashgrid.llm.suffix_dedup import repeated_strings  # noqa: E402
from crashgrid.llm.token_files import token_files  # noqa: E402
from crashgrid.llm.url_filters import url_filter  # noqa: E402
from crashgrid.session import shared_folder  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def prose(seed, n):
    draw = random.Random(seed)
    return [draw.choice("bdfgklmnprst") + draw.choice("aeiou") + draw.choice(["", "n", "st"]) + str(draw.randrange(9)) for _ in range(n)]


def odd_rows():
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows."""
    long, passage = prose(1, 5000), prose(2, 120)
    near = list(prose(3, 200))
    family = []
    for i in range(8):
        near = near[:]
        near[i * 20 + 5] = f"changed{i}"
        family.append(" ".join(near))
    texts = [
        None, "", "   \n\t ", "one", "One  one\none", "a b c d e", "A B C D E", "naïve Ünï ☃ 😀 words",
        " ".join(long), " ".join(long), " ".join(long[:2500] + passage + long[2500:]), " ".join(passage),
        " ".join(prose(4, 60) + passage[:60] + prose(5, 60)), " ".join(["be"] * 300), " ".join(["be"] * 200),
        "\n".join(["same line here"] * 40), "x" * 3000, "\n\n a\n\nb  c <|endoftext|> d\t", *family,
    ]
    return [(i, t, "ab"[i % 2] if i % 3 else None, f"s{i % 4}" if i % 5 else None, -i) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_words long"  # n_words clashes on purpose


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def rows(frame, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}


@pytest.fixture(params=["odd", "docs"])
def table(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_reference_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    answer = connection.execute(sql.ORACLES[name])
    columns = [d[0] for d in answer.description]
    result = QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(result.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in result.collect()))) == sorted(map(repr, answer.fetchall()))


def test_near_duplicates(table):
    wanted = brute.near_duplicates(pairs(table), 80)
    result = near_duplicates(table)
    assert rows(result, "n_shingles", "component_id") == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in result.collect())


def test_groups_that_only_chains_connect(spark):
    words = prose(9, 100)
    chain = []
    for i in range(6):
        words = words[: 10 * i] + [f"new{i}"] + words[10 * i + 1 :]
        chain.append((i, " ".join(words)))
    frame = spark.createDataFrame(chain, "doc_id long, text string")
    assert rows(near_duplicates(frame, similarity=85), "n_shingles", "component_id") == brute.near_duplicates(chain, 85)


def test_near_duplicates_at_the_registered_similarity(table):
    assert rows(near_duplicates(table, similarity=85), "n_shingles", "component_id") == brute.near_duplicates(pairs(table), 85)


def test_near_duplicates_of_rows_without_id_and_texts_that_share_one(spark):
    w, v = " ".join(prose(31, 60)), " ".join(prose(32, 60))
    given = [(None, w), (None, w + " tail"), (1, w), (2, "x y"), (2, w + " more"), (3, None), (None, ""),
             (None, v), (None, v), (None, v + " end"), (4, " ".join(prose(33, 20))), (4, " ".join(prose(33, 20)))]
    frame = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    got = near_duplicates(frame, similarity=85).collect()
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["n_shingles"] not in (56, 57) or r["component_id"])
    assert found == [
        (False, 1, 56, 1, True), (False, 2, 1, 2, True), (False, 2, 57, 1, False), (False, 3, 0, 3, True),
        (False, 4, 16, 4, True), (False, 4, 16, 4, True), (True, 0, 0, None, True), (True, 0, 56, 1, False), (True, 0, 57, 1, False)]
    nameless = [(r["n_shingles"], r["kept"]) for r in got if r["doc_id"] is None and r["component_id"] is None and r["n_shingles"]]
    assert sorted(n for n, _ in nameless) == [56, 56, 57]
    assert {n for n, kept in nameless if kept} in ({56}, {57}) and len({k for n, k in nameless if n == 56}) == 1


def test_repeated_passages(table):
    assert rows(repeated_passages(table), "n_words", "n_removed", "kept_sha256") == brute.repeated_passages(pairs(table))


@pytest.mark.parametrize("crowded", [20_000, 1])
def test_repeated_strings(table, crowded):
    result = repeated_strings(table, crowded=crowded).drop("kept").collect()
    four = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r[c] for c in four) for r in result), key=str) == brute.repeated_strings(pairs(table))
    for r in result:
        assert r["n_kept"] == r["n_bytes"] - r["n_removed"] and r["removed_share"] == pytest.approx(r["n_removed"] / max(r["n_bytes"], 1))


def test_repeated_rows_are_copies(spark):
    text = " ".join(prose(6, 300))
    frame = spark.createDataFrame([(1, text), (1, text), (2, "short"), (None, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in repeated_strings(frame).orderBy("n_bytes").collect()] == [0] + 3 * [len(text)]
    assert [r["n_removed"] for r in repeated_passages(frame).collect()] == [0] * 4
    assert near_duplicates(frame).count() == 4
    assert quality_rules(frame.withColumn("source", F.lit("s"))).count() == 4


def test_repeated_strings_leave_only_the_tables_of_the_result(spark):
    shared = Path(shared_folder(spark).removeprefix("file://")) / "crashgrid"
    tables = lambda: set(shared.iterdir()) if shared.exists() else set()
    before = tables()
    text = "".join(random.Random(5).choices("abcdefgh", k=900))
    rows = [(n, f"{n}" * 30 + text[n:]) for n in range(6)]
    removed = {r["doc_id"]: r["n_removed"] for r in repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(removed[n] >= 890 for n in range(1, 6))
    left = {path.name.rsplit("-", 1)[0] for path in tables() - before}
    assert "facts" in left
    assert not left & {"scan", "spots", "recurring", "mine", "kinds", "open", "around", "crowded", "reached"}


def test_quality_measures(odd):
    got = rows(quality_rules(odd), "n_words", "n_repeat_words", "base_failed", "kept")
    for doc, text in pairs(odd):
        w = brute.WORDS(text or "")
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)} if len(w) < 1000 else set()
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert got[doc][:3] == (len(w), len(covered), failed)
        assert not (failed and got[doc][3])


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(prose(7, 80))
    made = [(i, good if i < 70 else "bad", "bad" if i >= 60 else f"h{i % 5}") for i in range(400)]
    got = rows(quality_rules(spark.createDataFrame(made, "doc_id long, text string, source string")), "kept")
    assert all(got[i][0] for i in range(60)) and not any(got[i][0] for i in range(60, 400))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://b.org", "x://com/de/", "http://notcom/de/", "http://spam.net/1", "http://spam.net/2"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(9, True), (9, None), (10, True)], "page_id long, bad boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(frame, outcomes).collect()}
    assert got[0] == got[2] == ("", "", None, "allow")
    assert got[4] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[5][2:] == ("example.org/en/1", "block") and got[6] == ("b.org", "", None, got[6][3])
    assert got[7][2:] == ("com/de/", "block") and got[8][2] is None
    assert got[9][3] == got[10][3] == "block"


def test_mix(spark, docs):
    labels = spark.read.parquet(f"{'/root/testdata/sf0.001'}/labels.parquet")
    got = mix(docs, labels).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["source"], []).append(r)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    total = sum(r["size"] for r in got)
    weights = dict(zip(sorted(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))], strict=True))
    target, full = {}, set()
    while True:  # share again until nobody is above three times its size
        rest = total - sum(3 * sum(r["size"] for r in sizes[s]) for s in full)
        open_weight = sum(w for s, w in weights.items() if s not in full)
        target = {s: 3 * sum(r["size"] for r in sizes[s]) if s in full else rest * w / open_weight for s, w in weights.items()}
        over = {s for s in sizes if s not in full and target[s] > 3 * sum(r["size"] for r in sizes[s])}
        if not over:
            break
        full |= over
    for s, members in sizes.items():
        assert members[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in members) - target[s]) <= max(r["size"] for r in members)
        assert max(r["copies"] for r in members) - min(r["copies"] for r in members) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, mix(docs.repartition(5), labels).collect()))


def test_mix_of_nothing_and_of_nulls(spark, odd):
    assert mix(odd.limit(0)).count() == 0
    assert mix(odd).where(F.col("taken") > 3 * F.col("size")).count() == 0
    assert mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first()["taken"] == 0


def test_fingerprints(table):
    cut = lambda x: {line[i : i + 512] for line in x.split("\n") for i in range(0, len(line), 512)}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    texts, got, prints = sorted(pairs(table)), rows(fingerprints(table), "n_chars", "edited_sha256", "near_edited", "near_next", "fingerprint"), {}
    for i, (doc, text) in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        wanted = (len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(cut(text), cut(edited)), alike(cut(text), cut(after)))
        assert got[doc][:2] == wanted[:2] and got[doc][2:4] == pytest.approx(wanted[2:])
        assert prints.setdefault(text, got[doc][4]) == got[doc][4]


def test_fingerprints_lose_no_row(spark):
    given = [(None, "a"), (None, "b"), (1, "c"), (1, "d\ne"), (1, "d\ne"), (2, None), (2, "")]
    got = fingerprints(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (0, 1), (1, 1), (1, 3), (1, 3), (2, 0), (2, 0)]
    order = sorted({(d or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for d, t in given})
    nexts = {(d, t): order[(i + 1) % len(order)][2] for i, (d, _, t) in enumerate(order)}
    edited = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + nexts[d, t][: len(t) // 2]).encode()).hexdigest()
                    for d, t in ((d or 0, t or "") for d, t in given))
    assert sorted(r["edited_sha256"] for r in got) == edited
    assert len({(r["doc_id"], r["fingerprint"]) for r in got}) == 5


@pytest.mark.parametrize("shared, apart", [(0, 0), (0, 3), (500, 1), (40, 90), (0, 700), (3000, 400)])
def test_sketches_give_back_the_digests_that_differ(spark, shared, apart):
    draw = random.Random(shared + apart)
    numbers = [draw.randrange(-(1 << 63), 1 << 63) for _ in range(shared + 2 * apart)]
    a, b = numbers[: shared + apart], numbers[:shared] + numbers[shared + apart :]
    frame = spark.createDataFrame([(1, a, b), (2, a, a), (3, [], b)], "id long, a array<long>, b array<long>")
    got = {r["id"]: r for r in differing(frame, ["id"]).collect()}
    assert sorted(got[1]["only_a"]) == sorted(set(a) - set(b)) and sorted(got[1]["only_b"]) == sorted(set(b) - set(a))
    assert got[2]["only_a"] == got[2]["only_b"] == [] and sorted(got[3]["only_b"]) == sorted(b) and got[3]["only_a"] == []
    assert got[2]["cells"] == 8 and got[1]["cells"] * 3 >= 2 * apart


def test_long_texts_take_seconds(spark):
    lines = lambda word: "\n".join(f"{word} {i}" for i in range(20_000))
    frame = spark.createDataFrame([(1, lines("one")), (2, lines("two"))], "doc_id long, text string")
    began = time.time()
    first, second = fingerprints(frame).orderBy("doc_id").collect()
    assert first["near_next"] == second["near_next"] == 0.0 and 0.2 < first["near_edited"] < 0.6
    assert time.time() - began < 120


def tokens(file, frame):
    tokenizer = Tokenizer.from_file(file)
    return {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in pairs(frame)}


def test_token_files(table, folder):
    wanted, at = tokens(WORD_BPE, table), 0
    got = rows(token_files(table, WORD_BPE, folder), "start", "n_tokens", "ids_crc32")
    for doc in sorted(wanted):
        assert got[doc] == (at, len(wanted[doc]), zlib.crc32(wanted[doc].tobytes()))
        at += len(wanted[doc])


def test_token_files_of_rows_without_id(spark, folder):
    frame = spark.createDataFrame([(None, "b"), (None, "a"), (-1, "c d"), (0, None), (0, "e")], "doc_id long, text string")
    got = token_files(frame, WORD_BPE, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, -1, 0, 0] and got[-2]["n_tokens"] == 1


def test_packing(table):
    wanted, windows, pieces = tokens(BYTE_BPE, table), {}, {}
    for r in pack_windows(table, BYTE_BPE).collect():
        ids = wanted[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for parts, size in [(p, None) for p in windows.values()] + [(pieces[d], len(ids)) for d, ids in wanted.items()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at <= 2048 if size is None else at == size


def test_language(docs, odd):
    model = train(docs, PIECES)
    found = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    got = rows(identify(odd, model), "lang_pred", "score")
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert all(0 <= score <= 1 for _, score in got.values())
    assert train(odd.where("lang is null"), PIECES) is None
    assert {x[0] for x in rows(identify(odd, None), "lang_pred").values()} == {"und"}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    results = [
        near_duplicates(none), repeated_passages(none), repeated_strings(none), fingerprints(none),
        token_files(none, WORD_BPE), pack_windows(none, BYTE_BPE), quality_rules(none), identify(none, None),
        url_filter(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean")),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_pipeline_stages(spark, docs, sf):
    import corpus_pipeline as P

    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf)
        assert docs.columns == before.columns, name
        assert docs.count() > 0
    assert set(brute.near_duplicates(pairs(P.minhash_dedup(spark, before, sf)), 80).values())
    assert P.run(spark, sf).count() > 0


@pytest.fixture(scope="module")
def planted(spark, docs):
    """Clean documents and, beside them, rows without id, repeated rows and two texts of one id."""
    from pyspark.sql import Row

    clean = docs.where("lang is not null").orderBy("doc_id").limit(60).collect()
    a, b, c = (" ".join(prose(s, 160)) for s in (21, 22, 23))
    made = [(None, a), (None, a), (None, b), (900_001, c), (900_001, c), (900_002, " ".join(prose(24, 200))),
            (900_002, " ".join(prose(25, 200))), (900_003, b + " changed"), (900_004, " ".join([*prose(26, 90), *prose(24, 200)[:70]])),
            (None, " ".join([*prose(27, 90), *prose(25, 200)[50:130]])), (None, ""), (900_005, None)]
    odd = [Row(**(clean[0].asDict() | {"doc_id": d, "text": t, "n_chars": len(t or "")})) for d, t in made]
    clashing = ["key", "row", "kept", "found", "copies", "_key", "_n", "_copies", "_digest", "digest", "component_id"]
    frame = spark.createDataFrame(clean + odd, docs.schema).repartition(3)
    return stored(frame.withColumns({c: F.lit(f"own {c}") for c in clashing}), "planted")


def numbered(frame):
    """Distinct rows, numbered by id (none last)."""
    rows = sorted({tuple(r) for r in frame.collect()}, key=lambda r: (r[0] is None, r[0] or 0, repr(r)))
    return dict(enumerate(rows)), frame.columns.index("text")


def listed(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


def test_pipeline_language_stage_by_rows(spark, planted, sf):
    import corpus_pipeline as P

    given = stored(planted.withColumn("at", F.monotonically_increasing_id()), "given")
    found = rows(identify(given, train(given, PIECES), "at"), "lang_pred", "score")
    wanted = [r for r in given.collect() if found[r["at"]][0] != "und" and found[r["at"]][1] >= P.MIN_LANGUAGE_SCORE]
    got = P.language_id(spark, given, sf)
    assert listed(got) == sorted(repr(tuple(r)) for r in wanted)
    assert any(r["doc_id"] is None for r in wanted)


def test_pipeline_minhash_stage_by_rows(spark, planted, sf):
    import corpus_pipeline as P

    by_number, text = numbered(planted)
    groups = brute.near_duplicates([(n, r[text]) for n, r in by_number.items()], 80)
    wanted = sorted(repr(r) for n, r in by_number.items() if groups[n][1] == n)
    assert listed(P.minhash_dedup(spark, planted, sf)) == wanted


def test_pipeline_passages_stage_by_rows(spark, planted, sf):
    import corpus_pipeline as P

    by_number, text = numbered(planted)
    removed = brute.repeated_passages([(n, r[text]) for n, r in by_number.items()])
    got, number = {}, {r: n for n, r in by_number.items()}
    empty = hashlib.sha256(b"").hexdigest()
    wanted = sorted(removed[number[tuple(r)]][2] for r in planted.collect()
                    if not (removed[number[tuple(r)]][1] and removed[number[tuple(r)]][2] == empty))
    got = P.substring_dedup(spark, planted, sf).collect()
    assert sorted(hashlib.sha256(" ".join(brute.WORDS(r["text"] or "")).encode()).hexdigest() for r in got) == wanted
    assert sum(n for _, n, _ in removed.values()) > 0


def test_pipeline_mix_stage_by_rows(spark, planted, sf):
    import corpus_pipeline as P

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    n = planted.count()
    wanted = {}
    plan = mix(planted, labels).select("source", "target", "size").collect()
    for r in P.mix_sources(spark, planted, sf).collect():
        wanted[r["source"]] = wanted.get(r["source"], 0) + len(brute.WORDS(r["text"] or ""))
    assert len(plan) == n
    for source in {r["source"] for r in plan}:
        mine = [r for r in plan if r["source"] == source]
        assert abs(wanted.get(source, 0) - mine[0]["target"]) <= max(r["size"] for r in mine)


def test_pipeline_packing_stage_by_rows(spark, planted, sf):
    import corpus_pipeline as P

    tokenizer, by_doc = Tokenizer.from_file(BYTE_BPE), {}
    for doc, text in pairs(planted):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        by_doc.setdefault(doc, []).append(ids)
    windows, lengths = {}, {}
    for r in P.pack(spark, planted, sf).collect():
        piece = slice(r["start"], r["start"] + r["length"])
        assert any(len(ids) == r["doc_tokens"] and zlib.crc32(ids[piece].tobytes()) == r["ids_crc32"] for ids in by_doc[r["doc_id"]])
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {doc: sum(map(len, texts)) for doc, texts in by_doc.items()}
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_a_text_is_judged_alone(spark, docs):
    model = train(docs, PIECES)
    few = docs.orderBy("doc_id").limit(20)
    alone = rows(identify(few.repartition(20, "doc_id"), model), "lang_pred", "score")
    assert alone == rows(identify(docs.coalesce(1), model).join(few.select("doc_id"), "doc_id"), "lang_pred", "score")
