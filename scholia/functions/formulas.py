"""Formulas in LaTeX as text that a reader knows: ``\\frac{1}{2}`` as 1/2, ``x^{2}`` as x².

A formula is read once from left to right.  What is open (groups, commands that still wait for arguments, scripts) is on a
stack of its own, so depth costs nothing.  Every node is kept as the text it reads as; a node that a script, ``\\mathbb`` or a
degree sign asks about also says what it is.  Anything that isn't known raises ``Unknown``, and the formula stays as it was.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, wraps
from typing import NamedTuple

# What commands read as.
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
GREEK_CAPITALS = "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega".split()
GREEK_VARIANTS = {"varepsilon": "ε", "vartheta": "ϑ", "varpi": "ϖ", "varrho": "ϱ", "varsigma": "ς", "varphi": "ϕ"}
SIGNS = """
times × div ÷ cdot · ast ∗ star ⋆ bullet ∙ circ ○ pm ± mp ∓ oplus ⊕ ominus ⊖ otimes ⊗ odot ⊙
leq ≤ le ≤ geq ≥ ge ≥ neq ≠ ne ≠ approx ≈ equiv ≡ sim ∼ simeq ≃ cong ≅ propto ∝ doteq ≐ ll ≪ gg ≫
infty ∞ partial ∂ nabla ∇ aleph ℵ forall ∀ exists ∃ nexists ∄ neg ¬ lnot ¬ land ∧ lor ∨ wedge ∧ vee ∨
cap ∩ cup ∪ uplus ⊎ setminus ∖ in ∈ notin ∉ ni ∋ subset ⊂ supset ⊃ subseteq ⊆ supseteq ⊇ emptyset ∅ varnothing ∅
angle ∠ measuredangle ∡ triangle △ square □ bigcirc ○ perp ⊥ parallel ∥ mid ∣ nmid ∤ permil ‰ percent %
therefore ∴ because ∵ degree ° prime ′ dagger † ddagger ‡ ldots … cdots ⋯ vdots ⋮ ddots ⋱ dots …
to → rightarrow → longrightarrow ⟶ leftarrow ← longleftarrow ⟵ uparrow ↑ downarrow ↓ leftrightarrow ↔ updownarrow ↕
Rightarrow ⇒ Leftarrow ⇐ Leftrightarrow ⇔ implies ⇒ impliedby ⇐ iff ⇔ mapsto ↦ rightsquigarrow ⇝
sum ∑ prod ∏ coprod ∐ int ∫ iint ∬ iiint ∭ oint ∮ bigcup ⋃ bigcap ⋂ bigvee ⋁ bigwedge ⋀ bigoplus ⨁ bigotimes ⨂
langle ⟨ rangle ⟩ lVert ‖ rVert ‖ vert | Vert ‖ complement ∁ subsetneq ⊊ supsetneq ⊋ varsubsetneq ⊊
nleq ≰ ngeq ≱ nsim ≁ ncong ≆ napprox ≉ nsubset ⊄ nsupset ⊅ nsubseteq ⊈ nsupseteq ⊉ nequiv ≢ nparallel ∦ notni ∌
box □ blacksquare ■ lozenge ◇ diamond ◇ checkmark ✓ circledS Ⓢ wr ≀
"""
NEGATED = "= ≠ < ≮ > ≯ leq ≰ le ≰ geq ≱ ge ≱ in ∉ ni ∌ exists ∄ equiv ≢ sim ≁ cong ≆ approx ≉ subset ⊄ supset ⊅ subseteq ⊈ supseteq ⊉ mid ∤ nmid ∤ parallel ∦ nparallel ∦"
UPRIGHT = "sin cos tan cot sec csc arcsin arccos arctan arccot arcsec arccsc sinh cosh tanh coth log ln lg exp lim limsup liminf max min sup inf det dim deg arg gcd lcm hom ker Pr".split()
LITERAL = {"lvert": "|", "rvert": "|", "lbrace": "{", "rbrace": "}", "lbrack": "[", "rbrack": "]", "lfloor": "⌊", "rfloor": "⌋", "lceil": "⌈", "rceil": "⌉", **{c: c for c in "%$#&_^{}"}}
SPACES = [*",:;! ", "thinspace", "medspace", "thickspace", "negthinspace", "quad", "qquad", "enspace"]
SILENT = "displaystyle textstyle scriptstyle scriptscriptstyle limits nolimits ensuremath relax allowbreak".split()
DELIMITERS = "left right big Big bigg Bigg bigl bigr Bigl Bigr biggl biggr Biggl Biggr".split()
DOUBLE_STRUCK = {"R": "ℝ", "N": "ℕ", "Z": "ℤ", "Q": "ℚ", "C": "ℂ", "P": "ℙ", "H": "ℍ"}
RAISED = dict(zip("0123456789+-ni()", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿⁱ⁽⁾", strict=True))
LOWERED = dict(zip("0123456789+-aeioxn()", "₀₁₂₃₄₅₆₇₈₉₊₋ₐₑᵢₒₓₙ₍₎", strict=True))
PLAIN_STYLES = "text textrm mathrm mathbf textbf boldsymbol bm mathit textit emph".split()
BEFORE = {"vec": "→", "overrightarrow": "→", "overleftarrow": "←", "overleftrightarrow": "↔"}
BEHIND = {"overline": "(上划线)", "bar": "(上划线)", "underline": "(下划线)", "hat": "(帽)", "widehat": "(弧)", "dot": "(点)", "ddot": "(两点)"}
CASES = ("cases", "dcases", "rcases")
#: White space that is trimmed: what ECMAScript's trim takes.
BLANK = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: Environments inside environments that are read; deeper ones stay as they are.
DEEPEST = 50


def _pairs(text: str) -> dict[str, str]:
    parts = text.split()
    return dict(zip(parts[::2], parts[1::2], strict=True))


def _greek() -> dict[str, str]:
    of = lambda size, name: unicodedata.lookup(f"GREEK {size} LETTER {name.upper().replace('LAMBDA', 'LAMDA')}")
    return {n: of("SMALL", n) for n in GREEK} | {n: of("CAPITAL", n) for n in GREEK_CAPITALS} | GREEK_VARIANTS


_SIGNS, _NEGATED, _LETTERS = _pairs(SIGNS), _pairs(NEGATED), _greek()
_NAME, _NUMBER = re.compile(r"[a-zA-Z]+"), re.compile(r"[0-9]+(?:\.[0-9]+)?")


class Unknown(ValueError):
    pass


class Node(NamedTuple):
    text: str
    struck: str  # as it reads inside \mathbb
    sign: bool = False


class Open:
    """What is open: a group (``wants`` 0), a command that waits for arguments, or a script behind ``base``."""

    __slots__ = ("base", "got", "name", "nodes", "scripts", "wants")

    def __init__(self, name: str, wants: int = 0, base: Node | None = None):
        self.name, self.wants, self.base = name, wants, base
        self.nodes: list[Node] = []
        self.got: list[list[Node]] = []
        self.scripts: dict[str, list[Node]] = {}


def text_of(nodes: list[Node]) -> str:
    return "".join(n.text for n in nodes)


def _same(text: str, sign: bool = False) -> Node:
    return Node(text, text, sign)


def guarded(text: str) -> str:
    """Sums in brackets, where they stand in a fraction or under a root."""
    t = text.strip(BLANK)
    return f"({t})" if len(t) > 1 and ("+" in t or "-" in t) and not (t[0] == "(" and t[-1] == ")" and "\n" not in t) else t


def script(text: str, marks: dict[str, str], sign: str) -> str:
    t = text.strip(BLANK)
    return marks.get(t, f"{sign}({t})") if t else ""


def finished(o: Open) -> list[Node]:
    """The nodes that a command or script gives once it has its arguments."""
    name, arguments = o.name, [text_of(a) for a in o.got]
    if name == "^_":
        up = o.scripts.get("^")
        if up and len(up) == 1 and up[0].sign and up[0].text == _SIGNS["circ"]:
            return [*([o.base] if o.base else []), _same(_SIGNS["degree"], True)]
        low = script(text_of(o.scripts["_"]), LOWERED, "_") if "_" in o.scripts else ""
        return [_same((o.base.text if o.base else "") + low + (script(text_of(up), RAISED, "^") if up is not None else ""))]
    if name.startswith("sqrt"):
        index = name[4:]
        return [_same(("∛" if index == "3" else index + "√") + guarded(arguments[0]))]
    if name.endswith("frac"):
        return [_same(f"{guarded(arguments[0])}/{guarded(arguments[1])}")]
    if name.endswith("binom"):
        return [_same(f"C({arguments[0]},{arguments[1]})")]
    if name == "mathbb":
        struck = "".join(n.struck for n in o.got[0])
        return [_same(struck)]
    if name in BEFORE:
        return [_same(BEFORE[name] + arguments[0])]
    if name in BEHIND:
        return [_same(arguments[0] + BEHIND[name])]
    struck = "".join(n.struck for n in o.got[0])
    return [Node(f"(mod {arguments[0]})", f"(mod {struck})") if name in ("pmod", "pod") else Node(arguments[0], struck)]


WANTS = {n: 1 for n in (*PLAIN_STYLES, *BEFORE, *BEHIND, "mathbb", "pmod", "pod")} | {n: 2 for n in ("frac", "dfrac", "tfrac", "cfrac", "binom", "dbinom", "tbinom")}


class Reader:
    def __init__(self, source: str, depth: int = 0):
        if depth > DEEPEST:
            raise Unknown("environments in environments")
        self.s, self.at, self.depth = source, 0, depth
        self.stack = [Open("")]

    def read(self) -> list[Node]:
        s, stack = self.s, self.stack
        while True:
            top = stack[-1]
            if top.name == "^_" and not top.wants:
                if s[self.at : self.at + 1] in ("^", "_"):
                    self._script(top)
                else:
                    stack.pop()
                    stack[-1].nodes.extend(finished(top))
                continue
            if self.at >= len(s):
                if len(stack) > 1:
                    raise Unknown("something is still open")
                return top.nodes
            c = s[self.at]
            if c == "{":
                self.at += 1
                stack.append(Open("{"))
            elif c == "\\":
                self._command()
            elif not top.wants and c == "}":
                if top.name != "{":
                    raise Unknown("}")
                self.at += 1
                stack.pop()
                self._give(top.nodes if stack[-1].wants else [Node(text_of(top.nodes), "".join(n.struck for n in top.nodes))])
            elif not top.wants and c in "^_":
                base = top.nodes.pop() if top.nodes else None
                stack.append(Open("^_", base=base))
                self._script(stack[-1])
            elif not top.wants and c in "&#":
                raise Unknown(c)
            else:
                self._give([self._plain(c)])

    def _give(self, nodes: list[Node]) -> None:
        """Nodes that were read go to what is open: into a group, or as an argument, which may complete a command."""
        while self.stack[-1].wants:
            top = self.stack[-1]
            top.wants -= 1
            if top.name[:2] == "^_":
                top.scripts[top.name[2:]] = nodes
                top.name = "^_"
                return
            top.got.append(nodes)
            if top.wants:
                return
            self.stack.pop()
            nodes = finished(top)
        self.stack[-1].nodes.extend(nodes)

    def _script(self, o: Open) -> None:
        o.name, o.wants = "^_" + self.s[self.at], 1
        self.at += 1

    def _plain(self, c: str) -> Node:
        number = _NUMBER.match(self.s, self.at)
        if number:
            self.at = number.end()
            return _same(number[0])
        self.at += 1
        return Node(c, DOUBLE_STRUCK.get(c, c))

    def _name(self) -> str:
        name = _NAME.match(self.s, self.at)
        name = name[0] if name else self.s[self.at : self.at + 1]
        self.at += len(name)
        return name

    def _command(self) -> None:
        self.at += 1
        name = self._name()
        if name in SPACES:
            self._give([_same(" ")])
        elif name == "sqrt":
            index = ""
            if self.s[self.at : self.at + 1] == "[":
                end = self.s.find("]", self.at)
                if end < 0:
                    raise Unknown("[")
                index = text_of(Reader(self.s[self.at + 1 : end], self.depth + 1).read())
                self.at = end + 1
            self.stack.append(Open("sqrt" + index, 1))
        elif name in WANTS:
            self.stack.append(Open(name, WANTS[name]))
        elif name in ("bmod", "mod"):
            self._give([_same(" mod ")])
        elif name == "not":
            if self.s[self.at : self.at + 1] == "\\":
                self.at += 1
                name = self._name()
            else:
                name = self.s[self.at : self.at + 1]
                self.at += 1
            if name not in _NEGATED:
                raise Unknown("not " + name)
            self._give([_same(_NEGATED[name], True)])
        elif name == "begin":
            self._give([self._environment()])
        elif name in SILENT or name in DELIMITERS:
            if name in DELIMITERS and self.s[self.at : self.at + 1] == ".":
                self.at += 1
            self._give([])
        elif name in _SIGNS:
            self._give([_same(_SIGNS[name], True)])
        elif name in _LETTERS or name in LITERAL or name in UPRIGHT:
            self._give([_same(_LETTERS.get(name) or LITERAL.get(name) or name)])
        else:
            raise Unknown("\\" + name)

    def _environment(self) -> Node:
        if self.s[self.at : self.at + 1] != "{":
            raise Unknown("begin")
        begin, depth = self.at + 1, 1
        self.at += 1
        while self.at < len(self.s) and depth:
            c = self.s[self.at]
            depth += (c == "{") - (c == "}")
            self.at += 2 if c == "\\" else 1
        if depth:
            raise Unknown("begin{")
        name = self.s[begin : self.at - 1]
        end = self.s.find(f"\\end{{{name}}}", self.at)
        if end < 0:
            raise Unknown("end")
        body, self.at = self.s[self.at : end], end + len(name) + 6
        rows = []
        for row in body.split("\\\\"):
            cells = [text_of(Reader(cell, self.depth + 1).read()).strip(BLANK) for cell in row.split("&")]
            cells = [x for x in cells if x]
            if name in CASES:
                cells = [f"{cells[1]}时{cells[0]}"] if len(cells) > 1 else cells
            rows.append(" ".join(cells))
        return _same("；".join(r for r in rows if r))


#: Texts and formulas up to so many characters are remembered, and how many of each a worker keeps at most.
REMEMBERED, MOST_REMEMBERED = 200, 1 << 16


def remembered(read):
    """read(text), with the results of short texts kept: the same formulas come up again and again."""
    kept = lru_cache(MOST_REMEMBERED)(read)
    return wraps(read)(lambda s: kept(s) if s is None or len(s) <= REMEMBERED else read(s))


@remembered
def readable_formula(source: str) -> str:
    """One formula; as it is (trimmed) if it holds something unknown."""
    t = source.strip(BLANK)
    try:
        return text_of(Reader(t).read())
    except Unknown:
        return t


_DISPLAY, _INLINE = re.compile(r"\$\$|\\\["), re.compile(r"\$|\\\(")
_TO_DOLLAR, _BARE, _HAS_COMMAND = re.compile(r"([^$\n]+)\$"), re.compile(r"[^$\n]+"), re.compile(r"\\[a-zA-Z]")


def spans(text: str, display: bool) -> Iterator[tuple[int, int, int, int]]:
    """Formulas between marks of displayed lines, or of formulas in a line: begin, begin and end of the source, end.

    Each mark looks for its end once: where there is none, there is none for later ones.
    """
    at, unclosed = 0, set()
    while (m := (_DISPLAY if display else _INLINE).search(text, at)) is not None:
        begin, at = m.start(), m.end()
        if m[0] == "$":
            inner = _TO_DOLLAR.match(text, at)
            if inner:
                yield begin, inner.start(1), inner.end(1), (at := inner.end())
            continue
        close = {"$$": "$$", "\\[": "\\]", "\\(": "\\)"}[m[0]]
        end = -1 if close in unclosed else text.find(close, at + 1)
        if end < 0:
            unclosed.add(close)
            at = begin + 1
            continue
        yield begin, at, end, (at := end + len(close))


def _replaced(text: str, display: bool, give) -> str:
    out, at = [], 0
    for begin, lo, hi, end in spans(text, display):
        out += [text[at:begin], give(readable_formula(text[lo:hi]))]
        at = end
    return "".join([*out, text[at:]])


@remembered
def readable(text: str | None) -> str:
    """A text with its formulas as they read: displayed ones on lines of their own, those in a line, and stretches with bare commands."""
    s = (text or "").strip(BLANK)
    if "$" not in s and "\\" not in s:
        return s
    s = _replaced(s, True, lambda f: f"\n{f}\n")
    s = _replaced(s, False, lambda f: f)
    return _BARE.sub(lambda m: readable_formula(m[0]) if _HAS_COMMAND.search(m[0]) else m[0], s)


def pieces(text: str | None) -> list[tuple[int, str, str]]:
    """Lines of a text as pieces: line, kind (text, math or display), value."""
    out: list[tuple[int, str, str]] = []
    line, at, text = 0, 0, text or ""

    def plain(chunk: str) -> None:
        nonlocal line
        for one in chunk.split("\n") if chunk else ():
            last = 0
            for begin, lo, hi, end in spans(one, False):
                if begin > last:
                    out.append((line, "text", one[last:begin]))
                out.append((line, "math", one[lo:hi].strip(BLANK)))
                last = end
            if last < len(one):
                out.append((line, "text", one[last:]))
            line += 1

    for begin, lo, hi, end in spans(text, True):
        plain(text[at:begin])
        out.append((line, "display", text[lo:hi].strip(BLANK)))
        line, at = line + 1, end
    plain(text[at:])
    return out
