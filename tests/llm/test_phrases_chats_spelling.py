"""Collocations, chat formatting and spelling variants against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from crashgrid.llm.chat import INSTRUCTIONS, Renderer, Template, escape, format_chats, parse_instructions, read_chats, unescape
from crashgrid.llm.collocations import collocations
from crashgrid.llm.spelling import PER_TASK, counted_words, near_words, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+").findall
CLASHING = ["lang2", "prefix", "next", "n", "word", "key", "part", "position", "span", "rank"]


def with_own_columns(frame):
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


# --- collocations


def brute_collocations(docs, least, share=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        rows = []
        for p, a in candidates.items():
            if 100 * longest[p] < share * a or p not in longest:
                score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), count[p[:k]], count[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


def phrase_rows():
    draw = random.Random(5)
    words = ["new", "York", "city", "de", "la", "naïve", "ÉTÉ", "☃", "x", "\x00y", "😀"]
    rows = [(None, None), ("en", None), ("en", ""), (None, "   \t "), ("en", ". , ;"), ("en", "one"), ("fr", "a.b.c.d e"),
            ("en", "same same same same same same"), ("en", " ".join(["long"] * 3000)), ("de", "New York\tcity  New York city")]
    for i in range(200):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(draw.randrange(60)))
        rows.append((["en", "fr", None, "zz"][i % 4], text))
    return rows + rows[20:40]


@pytest.mark.parametrize("least", [2, 6])
def test_collocations(spark, least):
    rows = phrase_rows()
    frame = with_own_columns(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    got = sorted(tuple(r) for r in collocations(frame, least=least).collect())
    wanted = brute_collocations(rows, least)
    assert got == wanted and len(got) > (100 if least == 2 else 5)


def test_collocations_share_and_top(spark):
    rows = phrase_rows()
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations(frame, least=3, subsumed=30, top=7).collect()) == brute_collocations(rows, 3, 30, 7)


def test_no_phrases(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    few = spark.createDataFrame([(None, None), ("en", "a"), ("en", "a b"), ("en", "a b c")], "lang string, text string")
    assert collocations(few.repartition(4, "text")).count() == 0
    assert sorted(r["phrase"] for r in collocations(few.repartition(4, "text"), least=1).collect()) == ["a b", "a b c"]


# --- chats

NASTY = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST] <\\/s>", "<s><s>", "[TURN x] [/TURN]", "\\", "[", "<", " [/INST", "", "a\nb\n", "😀 é", "[INST", "</s"]


@pytest.mark.parametrize("text", NASTY)
def test_escapes_can_be_taken_back(text):
    assert unescape(escape(text)) == text
    assert not re.search(r"[<\[](/?INST\]|/?TURN|/?s>)", escape(text))


def chat_rows():
    roles = ["user", "assistant", "system", None, "a] b%[INST]"]
    rows = [(1, i, roles[i % 5], t) for i, t in enumerate(NASTY)] + [(1, i, "assistant", t) for i, t in enumerate(NASTY, 20)]
    rows += [(2, None, "user", None), (2, 0, "assistant", None), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    rows += [(None, 3, "user", "no id"), (None, 1, "assistant", "first"), (3, 0, "assistant", "x" * 100_000), (4, 0, "user", "alone")]
    return rows + [(5, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(5000)]


def test_chats_come_back(spark):
    rows = chat_rows()
    frame = with_own_columns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    formatted = format_chats(frame).cache()
    got = {r["conv_id"]: r for r in read_chats(formatted).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        learnt = "".join(t for *_, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        whole = INSTRUCTIONS.render([(r, t) for *_, r, t in turns], False)
        row = got[conv]
        assert row["n_turns"] == len(turns) and row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert row["loss_chars"] == len(learnt) and row["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
        assert row["formatted_chars"] == len(whole) and not row["rewrites"]
        spans = [r["span"] for r in formatted.where(F.col("conv_id").eqNullSafe(F.lit(conv))).orderBy("position").collect()]
        assert "".join(spans) == whole and parse_instructions(whole) == [(r, t) for *_, r, t in turns]
    formatted.unpersist()
    assert read_chats(format_chats(frame.limit(0))).count() == 0


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # templates travel to the tasks


def forgetful(messages, prompt):
    """Shows what assistants thought only in the last turn."""
    last = len(messages) - 1
    body = "".join(f"{r}:{t if i == last or r != 'assistant' else t.split('|')[-1]};" for i, (r, t) in enumerate(messages))
    return body + ("assistant:" if prompt else "")


def counting(messages, prompt):
    """Numbers its turns, so that a turn depends on all before it."""
    return "".join(f"{i}{r}={t};" for i, (r, t) in enumerate(messages)) + (f"{len(messages)}assistant=" if prompt else "")


def test_templates_that_rewrite_history_are_told():
    renderer = Renderer(Template(forgetful, str))
    assert renderer.add("user", "q") == ("user:q;", 0, 0)
    assert renderer.add("assistant", "hm|a") == ("assistant:hm|a;", 10, 14) and not renderer.rewritten
    renderer.add("user", "next")
    assert renderer.rewritten


def test_templates_that_look_far_back():
    renderer, out = Renderer(Template(counting, str)), ""
    messages = [(["user", "assistant"][i % 2], f"t{i}") for i in range(30)]
    for role, text in messages:
        span, low, high = renderer.add(role, text)
        assert span[low:high] == (text if role == "assistant" else "")
        out += span
    assert out == counting(messages, False) and not renderer.rewritten


def test_every_prefix_is_rendered_whole():
    shown = []

    def render(messages, prompt):
        shown.append((len(messages), prompt))
        return INSTRUCTIONS.render(messages, prompt)

    renderer = Renderer(replace(INSTRUCTIONS, render=render))
    for i in range(12):
        renderer.add(["user", "assistant"][i % 2], f"t{i}")
    assert [n for n, prompt in shown if not prompt] == list(range(1, 13))
    assert [n for n, prompt in shown if prompt] == list(range(1, 13, 2))


def test_rewriting_reaches_the_rows(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "hm|a"), (1, 2, "user", "r"), (1, 3, "assistant", "x|b")],
                                  "conv_id long, turn long, role string, text string")
    rows = format_chats(frame, Template(forgetful, str)).orderBy("position").collect()
    assert [r["rewrites"] for r in rows] == [False, False, True, True]
    assert [(r["loss_low"], r["loss_high"]) for r in rows] == [(0, 0), (10, 14), (0, 0), (0, 0)]


# --- spelling variants


def brute_words(docs, every, shortest=6, least=5):
    count = Counter()
    for doc, text in docs:
        for run in LETTERS(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if n >= least and len(w) >= shortest}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio=5):
    near = {w: [x for x in words if x != w and one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= ratio * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def spelling_rows():
    draw = random.Random(11)
    base = ["quantity", "receive", "naïveté", "ÀÉÎÕü", "aaaaaaa", "aaaaaaaa", "abcabcabc", "strasse", "straße", "zzyzxx"]
    words = []
    for w in base:
        for k in (1, 6, 40, 220):
            v = list(w)
            for _ in range(draw.randrange(3)):
                v[draw.randrange(len(v))] = draw.choice("abeitéÿ")
            if k == 6 and len(v) > 6:
                del v[draw.randrange(len(v))]
            words += ["".join(v).title() if k % 2 else "".join(v)] * k
    words += ["chaina"] * 8 + ["chainb"] * 60 + ["chainbc"] * 400 + ["chainbcd"] * 2600
    draw.shuffle(words)
    rows = [(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(len(words) // 20 + 1)]
    return rows + [(None, "receive receive " * 5), (None, None), (900, ""), (901, "x" * 3000 + " " + "x" * 3001), (901, "x" * 3000), (902, "a1b2 ×÷ÃĀreceive")] + rows[:9]


@pytest.mark.parametrize("per_task", [PER_TASK, 2])
def test_spelling_variants(spark, per_task):
    rows = spelling_rows()
    frame = with_own_columns(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted(tuple(r) for r in spelling_variants(frame, every=7, per_task=per_task).collect())
    words = brute_words(rows, 7)
    assert got == brute_variants(words)
    assert any(r[1] for r in got) and any(r[1] and r[2] != r[1] for r in got)


def test_spelling_of_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    words = brute_words([tuple(r) for r in docs.collect()], 199)
    assert sorted(tuple(r) for r in spelling_variants(docs).collect()) == brute_variants(words)


def test_dense_neighbourhoods(spark):
    draw = random.Random(3)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.choice([6, 7, 8]))) for _ in range(700)})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(r["word"], r["near"]) for r in near_words(frame, 100).collect()}
    wanted = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert {tuple(sorted(p)) for p in got} == wanted and len(got) == len(wanted)


def test_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(none).count() == 0 and counted_words(none).count() == 0
