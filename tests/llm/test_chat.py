import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelframe.llm import chat
from voxelframe.llm.template import Const, Out, Template, TemplateError, conversation


def render(source, **values):
    return Template(source).render(**values)[0]


@pytest.mark.parametrize(
    "source, want",
    [
        ("a{{ 1 + 2 * 3 }}b", "a7b"), ("{{ 'x' ~ 2 ~ none }}", "x2"), ("{{ (1 if false else 'n') | upper }}", "N"), ("{{ not 1 == 2 and 3 in [1] }}", None),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "1p,2q"), ("{% if a.b %}1{% elif a['c'] == 3 %}2{% else %}3{% endif %}", "2"),
        ("x  {%- set y = 'z' -%}  {{ y }}", "xz"), ("{# no #}k", "k"), ("{{ missing }}{{ missing.more }}", ""), ("{{ xs[0] }}{{ xs[9] }}{{ -2 % 3 }}", "p1"), ("{{ 'q' not in xs }}", "False"),
        ("{{ ' a ' | trim | length }}", "1"), ("{{ 'it\\'s\\n' }}", "it's\n"),
    ],
)
def test_language(source, want):
    if want is None:
        with pytest.raises(TemplateError):
            Template(source)
    else:
        assert render(source, xs=["p", "q"], a={"c": 3}) == want


@pytest.mark.parametrize("source", ["{% for %}", "{{ 1 + }}", "{{ x.__class__ }}", "{{ f() }}", "{% if 1 %}", "{{ x | nothing }}", "{% import os %}", "{{ 'a' 'b' }}"])
def test_bad_templates_are_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize("source", ["{{ 'a' * 1000000000 }}", "{{ '%999999999d' % 1 }}"])
def test_no_huge_texts(source):
    with pytest.raises(TemplateError):
        render(source)


def test_objects_are_closed():
    class Secret:
        key = "no"

    assert render("{{ s.key }}", s=Secret()) == ""


def test_constants_are_folded():
    tree = Template("a{{ 1 + 1 }}{% if true %}b{% else %}{{ x }}{% endif %}{{ 'c' | upper }}").tree
    assert tree == (Out(Const("a2bC")),)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>s/[]:\\a \n", max_size=30))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in (chat.BEGIN, chat.COLON, chat.STOP, "[INST]", "[/INST]"))


def want(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(loss), sha(loss)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", None, "<s>[:]"]), st.one_of(st.none(), st.text(alphabet="<>s/[]:\\a \né", max_size=20))), max_size=6))
def test_read_back_equals_the_turns(turns):
    template = chat.compile_template()
    got = chat.digest(template, turns)
    assert got[:4] == want(turns)
    text, spans = template.render(messages=conversation(turns))
    assert got[4] == len(text)
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t or "" for r, t in turns if r == "assistant")


def test_long_conversations_stream():
    def rows():
        for i in range(50_000):
            yield ("assistant" if i % 2 else "user", f"turn {i}")

    assert chat.digest(chat.compile_template(), rows())[:1] == (50_000,)


def test_query_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a<s>b", "x" * 50, "é\\["]), "other") for c in [1, 2, 3, None] for t in range(7)]
    rows += [(5, 1, "user", "b", "o"), (5, 1, "user", "a", "o"), (5, 1, "user", "a", "o"), (5, None, "assistant", "first", "o")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.format_digests(df).collect()}
    least = lambda v: (v is not None, v or "")
    for conv in (1, 2, 3, None, 5):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, least(r[2]), least(r[3])))
        assert got[conv] == want([(r[2], r[3]) for r in turns])
    parts = chat.formatted(df).where("conv_id = 1").orderBy("part").collect()
    assert chat.Reader is not None and sum(len(p["text"]) for p in parts) > 0
    assert chat.format_digests(df.where("false")).count() == 0


def test_ids_of_any_type(spark):
    rows = spark.createDataFrame([("x", 0, "user", "a"), ("x", 1, "assistant", "b"), ("y", 0, "user", None)], "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_digests(rows).collect()}
    assert {c: (r["n_turns"], r["loss_chars"]) for c, r in got.items()} == {"x": (2, 1), "y": (1, 0)}
    assert {r["conv_id"] for r in chat.formatted(rows).collect()} == {"x", "y"}
