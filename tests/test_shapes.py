"""Facts by shape against facts of each text alone."""

import random

import pyarrow as pa

from quarry.functions import shapes
from quarry.functions.lexer import SPAN, code_facts
from quarry.operators import graph, symbols
from quarry.plans import corpora as c

WANTED = ("symbols", "calls", "variables", "spans", "lines")


def test_texts_of_one_shape_are_read_once(monkeypatch):
    texts = [f"def make_{k}(x):\n    supply_{k * k}(x, {k})\n" for k in range(2000)]
    read, own = [], shapes._read
    monkeypatch.setattr(shapes, "_read", lambda *a: read.append(a) or own(*a))
    got = shapes.facts_of(texts, ["python"] * 2000, WANTED, {}).to_pylist()
    assert len(read) == 1 and got[:50] + got[-50:] == [code_facts(x, "python") for x in texts[:50] + texts[-50:]]


def test_shapes_give_what_each_text_gives_alone():
    dice = random.Random(5)
    names, pieces = ["a", "bb", "make_1"], "if else def class fn let mut for in case 12 3.5 v$ new const func type impl return enum void async ( ) { } [ ] ; : , . = == => := < > ! # @ // /* */ | ' \" \\".split() + ["\n", "\n    "]
    texts = [(body.replace("N", n), x) for x, body in c.SHAPES.items() for n in ("1", "345")]
    texts += [(x[1].replace("⟦", "").replace("⟧", "").replace("{n}", n).replace("{c}", "é" * (n == "b")), x[0]) for x in c.FORMS for n in ("a", "b", "made_1")]
    for _ in range(1500):
        own, language = [dice.choice(names if dice.random() < 0.4 else pieces) for _ in range(dice.randint(1, 30))], dice.choice(list(SPAN))
        texts += [(" ".join(x + str(k) * k if x in names else x for x in own), language) for k in range(3)]
    texts += [("x", "markdown"), ("", "go"), (None, "java")]
    got = shapes.facts_of([x[0] for x in texts], [x[1] for x in texts], WANTED, {}).to_pylist()
    assert got == [code_facts(x[0] or "", x[1]) for x in texts]


def test_rust_binds_whole_names():
    assert [v["name"] for v in code_facts("fn f() { let value = 1; let mut other: i32 = 2; let Some(inner) = g(); let (p, qq) = h(); }", "rust")["variables"]] == ["value", "other", "inner", "p", "qq"]


def test_calls_keep_the_callers_that_the_lexer_found(spark):
    files = symbols.with_facts(c.shape_files(spark, "/root/testdata/sf0.001"))
    calls, own = symbols.extract_calls(files), symbols.extract_symbols(files)
    columns = ["path", "callee", "line", "start_byte", "caller"]
    want = sorted(map(tuple, graph.enclosing_symbol(calls, own).select(*columns).collect()))
    assert want and sorted(map(tuple, graph.enclosing_symbol(calls).select(*columns).collect())) == want
    assert {tuple(r) for r in graph.caller_pairs(calls).collect()} == {(x[4], x[1]) for x in want}


def test_texts_equal_but_for_digits_are_not_cut(monkeypatch):
    texts = [f"def make_{k}(x):\n    supply_{k * k}(x, {k})\n" for k in range(3000)]
    cuts, own = [], shapes.cut
    monkeypatch.setattr(shapes, "cut", lambda *a: cuts.append(a) or own(*a))
    batch = pa.array([None, *texts], pa.string()).slice(1)
    got = shapes.facts_of_batch(batch, pa.array(["python"] * 3000), WANTED, {}).to_pylist()
    assert not any(shapes.DIGITS.search(w) for w in shapes.FIXED)
    assert len(cuts) == 1 and got[:50] + got[-50:] == [code_facts(x, "python") for x in texts[:50] + texts[-50:]]


def test_batches_give_what_each_text_gives_alone():
    dice = random.Random(6)
    names, pieces = ["a", "bb", "make_#", "#", "x#y#", "0x#", "v$#", "#e#", "#"], "if else def class fn let mut for in case 12 3.5 v$ new const func type impl return enum void async ( ) { } [ ] ; : , . = == => := < > ! # @ // /* */ | ' \" \\ é i32".split() + ["\n", "\n    "]
    texts = [(body.replace("N", str(n)), x) for x, body in c.SHAPES.items() for n in range(7)] + [(x[1].replace("⟦", "").replace("⟧", "").replace("{n}", f"n{n}").replace("{c}", "c"), x[0]) for x in c.FORMS for n in range(95, 105)]
    for _ in range(800):
        own, language = [dice.choice(names if dice.random() < 0.5 else pieces) for _ in range(dice.randint(0, 30))], dice.choice(list(SPAN))
        texts += [("".join(str(dice.randrange(10 ** dice.randint(1, 9))) if x == "#" else x for x in " ".join(own)), language) for _ in range(dice.randint(1, 9))]
    texts += [("x", "markdown")] * 5 + [("", "go")] * 6 + [(None, "java")] * 5 + [("1", None)] * 5 + [("12", "go"), ("3", "go"), ("4", "go"), ("5", "go")]
    dice.shuffle(texts)
    for some in (texts, texts[:1], []):
        got = shapes.facts_of_batch(pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.string()), WANTED, {}).to_pylist()
        assert got == [code_facts(x[0] or "", x[1]) for x in some]
