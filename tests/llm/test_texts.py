import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import answers as A
from spindrift.llm import leaks as L
from spindrift.llm.sentences import sentence_units, units
from spindrift.runtime import table


@pytest.mark.parametrize(
    "text,parts",
    [
        (None, []),
        ("", []),
        (" \r\n\t ", []),
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("Dr. Quill met J. R. Ludd at 5 p.m. The rest left.", ["Dr. Quill met J. R. Ludd at 5 p.m.", "The rest left."]),
        ("At 9 a.m. the job ran, e.g. twice. See Fig. 3.5 of No. 7.", ["At 9 a.m. the job ran, e.g. twice.", "See Fig. 3.5 of No. 7."]),
        ("It ends.Then v1.2 of conf.toml starts.", ["It ends.", "Then v1.2 of conf.toml starts."]),
        ("He said “Stop. Go.” and left. “It works,” she wrote, “so wait.” Then we did.", ["He said “Stop. Go.” and left.", "“It works,” she wrote, “so wait.”", "Then we did."]),
        ("The table (it did. Ask us!) is read. (See p. 4.) End", ["The table (it did. Ask us!) is read.", "(See p. 4.)", "End"]),
        ("Am 3. Mai lief es, z. B. um 1,5 Mio. Zeilen. Der 2. Lauf folgt!", ["Am 3. Mai lief es, z. B. um 1,5 Mio. Zeilen.", "Der 2. Lauf folgt!"]),
        ("M. Pym note « Non ! » et part. Bref… le cache, etc. Fin", ["M. Pym note « Non ! » et part.", "Bref… le cache, etc.", "Fin"]),
        ("Bueno... el nodo, ¿no? ¡Nunca! Fin.", ["Bueno... el nodo, ¿no?", "¡Nunca!", "Fin."]),
        ("表示は「終わり。次。」でした。次の文（旧版。参照。）も。", ["表示は「終わり。次。」でした。", "次の文（旧版。参照。）も。"]),
        ("डॉ. शून्य गए। विलंब 2.5 मि.से. रहा।", ["डॉ. शून्य गए।", "विलंब 2.5 मि.से. रहा।"]),
        ("ระบบหยุด งานเริ่ม top_k มากกว่า 4", ["ระบบหยุด", "งานเริ่ม top_k มากกว่า 4"]),
        ("# Title\n\nA line\nbroken here. Next\n\n- one\n- two. and\n  more\n1. x", ["# Title", "A line\nbroken here.", "Next", "- one", "- two. and\n  more", "1. x"]),
        ("A.\r\n\r\n1. x\r\n2. y\r\n\r\nB", ["A.", "1. x", "2. y", "B"]),
        ("“Unclosed. Still two.", ["“Unclosed.", "Still two."]),
    ],
)
def test_units(text, parts):
    assert [text[a:b] for a, b in units(text)] == parts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab A.!?。 \n\r\t-1“”()'\"ก…", max_size=80))
def test_units_hold_all_that_is_not_blank(text):
    found = units(text)
    assert all(b > a and text[a:b] == text[a:b].strip() for a, b in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    rest = "".join(text[a:b] for a, b in zip([0, *[x[1] for x in found]], [*[x[0] for x in found], len(text)]))
    assert not rest.strip()


def test_a_very_long_text_in_time():
    assert len(units("Word and word. " * 20_000)) == 20_000


def test_units_of_rows(spark):
    rows = spark.createDataFrame([(1, "Hm. Go.", "x"), (2, None, "x"), (3, "", "x"), (1, "Hm. Go.", "x")], "doc_id bigint, text string, start_char string")
    assert sorted(map(tuple, sentence_units(rows).collect())) == [(1, 0, 3), (1, 0, 3), (1, 4, 7), (1, 4, 7)]
    assert sentence_units(rows.limit(0)).count() == 0


# ---- leaks


def test_words():
    assert L.words("Ｆｕｌｌ-Width, don't  STOP½") == ["full", "width", "don", "t", "stop1", "2"] and L.words(None) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40), st.integers(2, 6))
def test_tiles_equal_a_plain_greedy_tiling(one, other, least):
    shared = [(i, j) for i in range(len(one) - least + 1) for j in range(len(other) - least + 1) if one[i : i + least] == other[j : j + least]]
    found = L.tiles(one, other, shared, least)
    longest = max([n for i in range(len(one)) for j in range(len(other)) for n in [next((k for k in range(len(one) + 1) if i + k >= len(one) or j + k >= len(other) or one[i + k] != other[j + k]), 0)]], default=0)
    assert (found[0][2] if found else 0) == (longest if longest >= least else 0)
    used = [x for i, _, n in found for x in range(i, i + n)]
    assert len(used) == len(set(used)) and all(one[i : i + n] == other[j : j + n] for i, j, n in found)


def test_running_hash_is_the_same_wherever_a_run_stands():
    codes = L._codes(list("abcabcxabc"), {})
    h = L.running_hash(codes, 3)
    assert h[0] == h[3] == h[7] and len(set(h.tolist())) == 6 and len(L.running_hash(codes[:2], 3)) == 0


@pytest.mark.parametrize("bits", [64, L.MOST_BITS])  # a filter that all hashes pass, and the usual one
def test_leaks(spark, monkeypatch, bits):
    monkeypatch.setattr(L, "MOST_BITS", bits)
    item = " ".join(f"w{i}" for i in range(30))
    ja = "再現率が下がるので同期エージェントが差分を書き直します"
    docs = [
        (1, "x " + " ".join(f"W{i}," for i in range(12)) + " y"),
        (2, " ".join(f"w{i}" for i in range(11))),
        (3, "前置き。" + ja[:12] + "\n" + ja[12:22] + "。"),
        (4, " ".join(f"w{i}" for i in [*range(20, 30), *range(10)])),
        (5, None),
        (6, ""),
    ]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(7, "en", item), (8, "ja", ja), (9, "en", None), (10, "en", "too short")], "item_id bigint, lang string, text string")
    assert sorted((r.doc_id, r.item_id) for r in L.leaks(d, i).collect()) == [(1, 7), (3, 8)]
    whole = {(r.doc_id, r.item_id): round(r.covered, 2) for r in L.leaks(d, i, seed=5, coverage=0.5).collect()}
    assert whole[4, 7] == 0.67  # passages in another order
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0


# ---- answers

Q = "How do I flush the delta batch in reviews?"


@pytest.mark.parametrize(
    "query,response,defect",
    [
        (Q, None, "empty"),
        (Q, " ​　﻿ ", "empty"),
        (Q, "<p>&nbsp;</p>", "empty"),
        (Q, "```\n```", "empty"),
        (Q, "[no response]", "empty"),
        (Q, "N/A", "empty"),
        ("Return the settings as JSON.", "{}", None),
        (Q, "-1", None),
        (Q, "coll.search(q, k=3)", None),
        (Q, "```python\nx = 1\n```", None),
        (Q, "conf/iris/merge.py", None),
        (Q, "Stop the writer. Then flush the bat", "truncated"),
        (Q, "Stop the writer. (We measured recall and", "truncated"),
        (Q, "Stop it.\n\n```python\nfor hit in coll:\n ", "truncated"),
        (Q, "1. Stop the writer.\n2. If the", "truncated"),
        (Q, "- alpha\n- beta", None),
        (Q, "Stop the writer and flush.", None),
        (Q, "> " + Q, "copy"),
        (Q, f"Answer: {Q.upper()} {Q}", "copy"),
        (Q, Q + " Stop the writer, run the check and flush the batch before you start it again.", None),
        ("ef_searchを99にすると何が変わりますか？", "EF_SEARCHを99にすると何が変わりますか", "copy"),
        (Q, "I'm sorry, but I can't help with that request. Thank you for understanding.", "refusal"),
        (Q, "Leider darf ich über reviews keine Auskunft geben.", "refusal"),
        (Q, "申し訳ありませんが、そのご質問にはお答えできません。", "refusal"),
        (Q, "The server answers “I cannot help with that request” here. Set top_k to 3 and flush it.", None),
        (Q, "Unfortunately the old flag is gone. Set top_k to 3, then flush the delta batch again.", None),
        (Q, "Stoppe den Schreiber, und danach prüfst du die Tabelle mit der neuen Einstellung.", "wrong_language"),
        ("Translate into German: stop the writer and flush it.", "Stoppe den Schreiber und leere ihn danach mit der neuen Einstellung.", None),
        (None, "Stop the writer.", None),
    ],
)
def test_single_pairs(profiles, query, response, defect):
    if A.is_empty(response, query):
        found = "empty"
    elif A.is_copy(response, query):
        found = "copy"
    else:
        found = "refusal" if A.declines(A.sentences(response)) else "wrong_language" if A.wrong_languages(profiles, [query], [response])[0] else "truncated" if A.is_truncated(response) else None
    assert found == defect


@pytest.fixture(scope="module")
def profiles(spark):
    return A.fit_profiles(table(spark, "/root/testdata/sf0.01", "documents").select("text", "lang"))


def test_profiles_tell_languages(spark, profiles):
    """Held out: documents of another table whose labels agree with their scripts; wrong labels are among them."""
    rows = table(spark, "/root/testdata/check_s", "documents").where("lang in ('en', 'de', 'fr', 'es') and length(text) > 60").select("text", "lang").limit(400).collect()
    n, scores = profiles.scores([r.text for r in rows])
    right = [profiles.names[i] == r.lang for i, r in zip(scores.argmax(1), rows)]
    assert sum(right) >= 0.9 * len(right)
    number, bucket = A.trigrams(["", "a", "ab  cd", None or "12 34", "x\x1ey"])
    assert len(number) == len(bucket) and set(number.tolist()) == {1, 2, 4}


def test_templates_reveal_refusals(spark):
    odd = "My guidelines do not allow me to look into reviews number {}."
    rows = [(i, f"Question {i} about thing {'abcdefgh'[i]}?", odd.format(i), "x") for i in range(6)] + [(20, None, "Fine then.", "x"), (21, "Why?", None, "x"), (21, "Why?", None, "x")]
    frame = spark.createDataFrame(rows, "entry_id bigint, query string, response string, defect string")
    assert sorted(map(tuple, A.defects(frame).collect())) == [(i, "refusal") for i in range(6)] + [(21, "empty"), (21, "empty")]
    assert A.defects(frame.limit(0)).count() == 0


def test_templates_reveal_refusals_the_lexicon_lacks(spark):
    topics = ["compaction", "reranking", "sharding", "backups", "tokenizers", "latency", "quotas", "tenants"]
    asked = [f"{'Why How When Where'.split()[i % 4]} {'fails runs starts stops grows'.split()[i % 5]} {t}?" for i, t in enumerate(topics)]
    odd, two = "That lies beyond my remit.", "This matter is off the table today. The desk upstairs deals with such things."
    for wording in (odd, odd + " Thank you.", two):
        assert not A.declines(A.sentences(wording))
    rows = [(i, q, odd + (" Thank you." if i % 2 else "")) for i, q in enumerate(asked)]
    rows += [(20 + i, q, two) for i, q in enumerate(asked)]
    # the opening goes on to an answer; a form that is filled in; a value; one question in other words
    rows += [(40, asked[0], odd + " Set the writer to lazy and flush the batch before the next merge.")]
    rows += [(50 + i, q, f"With the cache at {i} megabytes recall moved to {i + 7} percent.") for i, q in enumerate(asked)]
    rows += [(60 + i, q, "Yes.") for i, q in enumerate(asked)]
    rows += [(70 + i, f"{w} restart replicas?", "Run the nightly job once more.") for i, w in enumerate("please could kindly quickly safely slowly".split())]
    frame = spark.createDataFrame(rows, "entry_id bigint, query string, response string")
    assert sorted(map(tuple, A.defects(frame).collect())) == [(i, "refusal") for i in [*range(8), *range(20, 28)]]
    # without any word list: "Thank you." is too rare here to be told as a courtesy
    assert sorted(map(tuple, A.defects(frame, lexicon=False).collect())) == [(i, "refusal") for i in range(20, 28)]


def test_every_standard_terminator_ends_a_sentence():
    import regex
    import sys as system

    marks = regex.findall(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}]", "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, system.maxunicode + 1))))
    assert len(marks) >= 150
    for mark in marks:
        text = f"Worte stehen hier{mark} Danach folgt mehr{mark}"
        assert [text[a:b] for a, b in units(text)] == [f"Worte stehen hier{mark}", f"Danach folgt mehr{mark}"], hex(ord(mark))


@pytest.mark.parametrize("sentences", [
    ["ကျွန်ုပ်တို့သည် စာရင်းကို ဖတ်သည်။", "စနစ်သည် ရပ်နားသည်။", "ဒေတာများ ပျောက်ဆုံးသည်။"],  # Burmese
    ["ꦲꦏ꧀ꦱꦫꦗꦮ꧉", "ꦱꦸꦒꦼꦁꦫꦮꦸꦃ꧉"],  # Javanese
    ["ᱥᱟᱱᱛᱟᱲᱤ ᱯᱟᱹᱨᱥᱤ᱾", "ᱚᱞ ᱪᱤᱠᱤ᱾"],  # Santali
    ["ሰላም ነው።", "ደህና ነው፧"],
])
def test_scripts_with_their_own_terminators(sentences):
    for gap in ("", " "):
        text = gap.join(sentences)
        assert [text[a:b] for a, b in units(text)] == sentences
