"""Source text by its syntax, against sources that are generated with their statements known."""

import random
import re

import pytest

from marlspike.operators.syntax import OPAQUE, blanked, units

NASTY = ["'}'", '"{ // "', "`}`", "`${ {a: `}`} }{`", "/[{/]}/", "/\\/{/g", "'\\'{'", "/* { */ 1", "1 // {", "a / b / c", "[1, {b: 2}]", "x ? { y: 1 } : '{'"]
QUIET = [x for x in NASTY if "//" not in x]


def statement(rnd, n):
    v = lambda: rnd.choice(NASTY)
    body = "\n".join(f"  const v{i} = {v()}" for i in range(rnd.randrange(3)))
    inner = "\n".join(f"  {{ {i}; }}" for i in range(rnd.randrange(2)))
    doc = rnd.choice(["", "", f"/** About {n} {{ */\n", f"/**\n * {n} }}\n */\n"])
    out = rnd.choice(["", "export ", "export default "])
    kind = rnd.choice(["function", "interface", "type", "variable", "arrow", "class", "if", "call"])
    if kind == "function":
        return kind, f"f{n}", bool(out), f"{doc}{out}function f{n}(a = {{}}) {{\n{body}\n{inner}\n}}"
    if kind == "interface":
        return kind, f"I{n}", bool(out), f"{doc}{out}interface I{n} {{\n  a: {{ b: number }}\n}}"
    out = out.replace("default ", "")
    if kind == "type":
        return kind, f"T{n}", bool(out), f"{doc}{out}type T{n} =\n  | {{ a: '{{' }}\n  | number"
    if kind == "variable":
        return kind, f"v{n}", bool(out), f"{doc}{out}const v{n} = {v()}"
    if kind == "arrow":
        return "function", f"g{n}", bool(out), f"{doc}{out}const g{n} = async (a) => {{\n{body}\n}}"
    if kind == "class":
        return kind, f"C{n}", bool(out), f"{doc}{out}class C{n}<T extends {{ a: 1 }}> {{\n}}"
    if kind == "if":
        return "other", "", False, f"{doc}if (a({rnd.choice(QUIET)})) {{\n{body}\n}} else {{\n{inner}\n}}"
    return "other", "", False, f"{doc}call(function () {{\n{body}\n}})"


@pytest.mark.parametrize("seed", range(60))
def test_statements(seed):
    rnd = random.Random(seed)
    made = [statement(rnd, n) for n in range(rnd.randrange(1, 9))]
    text = "\n".join(x for s in made for x in (*rnd.choice([[], [""], ["// note {"]]), s[3]))
    assert units(text) == made


@pytest.mark.parametrize("seed", range(40))
def test_members(seed):
    rnd = random.Random(seed)
    fields, methods = [], []
    for n in range(rnd.randrange(1, 6)):
        v = rnd.choice(NASTY)
        if rnd.random() < 0.5:
            fields.append(("property", f"p{n}", f"  {rnd.choice(['', 'private ', 'static readonly '])}p{n} = {v}"))
        else:
            doc = rnd.choice(["", "  /** Does { it. */\n"])
            methods.append(("method", f"m{n}", f"{doc}  {rnd.choice(['', 'async ', 'get ', 'static async *'])}m{n}(a = {{}}) {{\n    use({v}\n    )\n  }}"))
    made = fields + methods
    rnd.shuffle(made)
    head = "export class K extends L<{ a: 1 }> {"
    got = units("\n".join([head, *(m[2] for m in made), "}"]))
    above = "\n".join([head, *(m[2] for m in made if m[0] == "property"), "  // ...", ""])
    assert got == [(kind, f"K.{name}", True, (above if kind == "method" else "") + content) for kind, name, content in made]


def test_blanked_keeps_places():
    rnd = random.Random(1)
    for _ in range(200):
        text = "\n".join(rnd.choice([*NASTY, "{", "}", "`", "'", "/*", "*/", "/", "${"]) for _ in range(rnd.randrange(12)))
        bare, comments = blanked(text)
        assert len(bare) == len(text) and [i for i, c in enumerate(bare) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        assert all(b in (c, " ", OPAQUE) for b, c in zip(bare, text, strict=True))
        units(text)  # whatever it is, it is read to its end


def test_imports_are_one_unit():
    text = "import a from 'a'\nimport {\n  b\n} from 'b'\n\nrun()\nimport c from 'c'"
    assert [(k, re.sub(r"\s+", " ", t)) for k, _, _, t in units(text)] == [("module", "import a from 'a' import { b } from 'b' import c from 'c'"), ("other", "run()")]
    assert units("") == [] and units("\n// only a comment\n") == []
