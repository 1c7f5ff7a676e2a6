import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmerge.llm import chat_format as cf
from shelfmerge.llm import chat_template as ct

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def render(template, messages=(), **names):
    return "".join(ct.Template(template).render(list(messages), **names).parts)


@pytest.mark.parametrize(
    ("template", "names", "want"),
    [
        ("a{{ 1 + 2 }}b", {}, "a3b"),
        ("{{ 'x' ~ y }}", {"y": 3}, "x3"),
        ("{% if a and not b %}1{% elif b %}2{% else %}3{% endif %}", {"a": 1, "b": 0}, "1"),
        ("{% if false %}x{% else %}y{% endif %}", {}, "y"),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": ["a", "b"]}, "1a,2b"),
        ("{{ m['k'].z | upper | default('q') }}", {"m": {"k": {"z": "v"}}}, "V"),
        ("{{ none | default('q') }}{# gone #}", {}, "q"),
        ("{% set a = 'x' %}{{ a if a == 'x' else 'no' }}", {}, "x"),
        ("a {{- 'b' -}} c", {}, "abc"),
        ("{{ 'in' if 'b' in 'abc' else 'out' }}{{ 'no' if 'z' not in 'abc' else '' }}", {}, "inno"),
        ("{{ x.__class__ }}{{ x.upper }}", {"x": "s"}, ""),
        ("{{ xs[1] }}{{ xs[9] }}", {"xs": [1, 2]}, "2"),
        ("{{ '</s>' | escape }}", {}, "<\\/s>"),
    ],
)
def test_language(template, names, want):
    assert render(template, **names) == want


@pytest.mark.parametrize("bad", ["{{ a( }}", "{% for x %}{% endfor %}", "{% if a %}", "{% endif %}", "{{ x | eval }}", "{% import os %}", "{{ 'a' - 1 }}", "{{ a b }}"])
def test_bad_templates(bad):
    with pytest.raises(ct.TemplateError):
        ct.Template(bad)


def test_constants_are_folded():
    tree = ct.fold(ct.parse("a{{ 'b' ~ 1 ~ (2 + 3) }}{% if 1 == 1 %}c{% endif %}{% if false %}{{ x }}{% endif %}{{ y }}"))
    assert tree == (ct.Out(ct.Const("ab15c")), ct.Out(ct.Name("y")))


def test_generation_spans_and_streaming():
    t = ct.Template("<{% for m in messages %}{% generation %}{{ m.a }}{{ m.b }}{% endgeneration %}{% generation %}!{% endgeneration %}|{% endfor %}>")
    messages = [{"a": "xy", "b": "z"}, {"a": "", "b": "é"}]
    w = t.render(messages)
    text = "".join(w.parts)
    assert text == "<xyz!|é!|>"
    assert [text[a:b] for a, b in w.spans] == ["xyz", "!", "é", "!"]
    assert "".join("".join(s.parts) for s in t.stream(iter(messages))) == text


CONTROL_TEXT = st.text(st.sampled_from("<s>/[INSTROLE]\\ é\n"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "[/ROLE]", "system\n"]) | CONTROL_TEXT, CONTROL_TEXT), max_size=4))
def test_escapes_reverse(turns):
    w = ct.Template(cf.TEMPLATE).render([{"role": r, "text": t} for r, t in turns])
    assert list(cf.read_turns("".join(w.parts))) == turns


def digests(turns):
    own = "".join(t for r, t in turns if r == "assistant")
    return (
        len(turns),
        hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
        len(own),
        hashlib.sha256(own.encode()).hexdigest(),
    )


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n_turns string").repartition(3)
    want = {}
    for c, k, r, t in sorted(rows, key=lambda x: ((x[0] is None, x[0] or 0), (x[1] is not None, x[1] or 0), x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    want[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.chat_report(spark, df).collect()}
    assert got == {c: digests(t) for c, t in want.items()}


def test_odd_conversations(spark):
    check(
        spark,
        [(1, 0, "user", None), (1, 1, "assistant", "a</s>b"), (1, 1, "assistant", "a</s>b"), (2, None, None, "x"), (2, 0, "assistant", ""),
         (None, 0, "user", "no id"), (3, 5, "assistant", "long " * 20000), (4, 0, "[/ROLE]", "[INST]\\[INST]")] + [(9, i, "assistant", f"t{i}") for i in range(700)],
    )
    check(spark, [])


def test_whole_table(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
