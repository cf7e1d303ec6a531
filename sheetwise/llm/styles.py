"""The rules of a page's style sheets that decide whether a screen shows an element."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

# The screen that pages are read on.
WIDTH, HEIGHT, EM = 1280, 720, 16
FEATURES = {
    "orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "hover", "any-hover": "hover",
    "pointer": "fine", "any-pointer": "fine", "scripting": "enabled", "update": "fast", "prefers-contrast": "no-preference", "display-mode": "browser",
}
#: a feature without a value that such a screen has
HAS = {"color", "hover", "any-hover", "pointer", "any-pointer", "width", "height", "scripting", "update"}
DISPLAYS = set(
    "none block inline inline-block flex inline-flex grid inline-grid flow-root contents list-item table inline-table table-row table-cell "
    "table-row-group table-header-group table-footer-group table-column table-column-group table-caption ruby ruby-base ruby-text "
    "inherit initial unset revert revert-layer run-in math -webkit-box -webkit-flex -webkit-inline-box -ms-flexbox".split()
)
VISIBILITIES = set("visible hidden collapse inherit initial unset revert revert-layer".split())
#: the parts of a selector for one element; selectors between commas; elements and combinators of one selector
SIMPLE = re.compile(
    r"(?P<mark>[.#][\w-]+)|(?P<tag>\*|(?<![\w-])[a-zA-Z][\w-]*)|:not\((?P<no>(?:\[[^\]]*\]|[^()\[])*)\)"
    r"|\[\s*(?P<name>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\s\]]+)\s*(?P<case>[iIsS]?)\s*)?\]"
)
LISTED = re.compile(r"(?:\[[^\]]*\]|\((?:\[[^\]]*\]|[^()\[])*\)|[^,\[(])+")
STEP = re.compile(r"[>+~]|(?:\[[^\]]*\]|\((?:\[[^\]]*\]|[^()\[])*\)|[^\s>+~\[(])+")
NUMBER = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+))(%?)$")
SIZE = re.compile(r"(\d*\.?\d+)(px|em|rem)?$")
PIECE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", re.S)

#: (important, inline, ids, classes, tags, order): the highest decides
Weight = tuple[bool, bool, int, int, int, int]


def declarations(body: str) -> Iterator[tuple[str, str, bool]]:
    """The valid declarations ``(property, value, important)`` of display, visibility and opacity."""
    for part in body.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in ("display", "visibility", "opacity"):
            value, bang, mark = value.strip().lower().partition("!")
            value, important = value.strip(), bang == "!" and mark.strip() == "important"
            if bang and not important:
                continue
            if name == "opacity":
                if m := NUMBER.match(value):
                    yield name, "0" if float(m[1]) <= 0 else "1", important
                elif value in ("inherit", "initial", "unset", "revert", "revert-layer"):
                    yield name, "1", important
            elif name == "display" and (value in DISPLAYS or value and set(value.split()) <= DISPLAYS - {"none"}) or value in VISIBILITIES and name == "visibility":
                yield name, value, important


class Simple:
    """A selector of one element: tag, classes and ids, attributes, and what it must not be."""

    def __init__(self, tag: str, marks: frozenset[str], attributes: list[tuple[str, str, str, bool]], nots: list[Simple]):
        self.tag, self.marks, self.attributes, self.nots = tag, marks, attributes, nots

    @staticmethod
    def read(text: str) -> Simple | None:
        """None for what is not understood: pseudo-classes and pseudo-elements other than ``:not`` of such selectors."""
        at, tag, marks, attributes, nots = 0, "*", set(), [], []
        while at < len(text):
            m = SIMPLE.match(text, at)
            if not m or m["tag"] and at:
                return None
            at = m.end()
            if m["mark"]:
                marks.add(m["mark"])
            elif m["tag"]:
                tag = m["tag"].lower()
            elif m["name"]:
                value = m["value"] or ""
                value = value[1:-1] if value[:1] in ("'", '"') else value
                attributes.append((m["name"].lower(), m["op"] or "", value, (m["case"] or "").lower() == "i"))
            else:
                inner = [Simple.read(x.strip()) for x in LISTED.findall(m["no"])]
                if not inner or None in inner:
                    return None
                nots += inner
        return Simple(tag, frozenset(marks), attributes, nots) if text else None

    def weight(self) -> tuple[int, int, int]:
        ids = sum(x[0] == "#" for x in self.marks)
        own = (ids, len(self.marks) - ids + len(self.attributes), int(self.tag != "*"))
        return tuple(map(sum, zip(own, max(n.weight() for n in self.nots)))) if self.nots else own

    def fits(self, tag: str, marks: frozenset[str], given: dict[str, str]) -> bool:
        if self.tag not in ("*", tag) or not self.marks <= marks:
            return False
        return all(_has(given, *a) for a in self.attributes) and not any(n.fits(tag, marks, given) for n in self.nots)


def _has(given: dict[str, str], name: str, op: str, value: str, fold: bool) -> bool:
    if name not in given:
        return False
    has, value = (given[name].lower(), value.lower()) if fold else (given[name], value)
    if op == "~=":
        return value in has.split()
    if op == "|=":
        return has == value or has.startswith(f"{value}-")
    if op in ("^=", "$=", "*="):
        return bool(value) and {"^": has.startswith, "$": has.endswith, "*": has.__contains__}[op[0]](value)
    return not op or has == value


def marks_of(given: dict[str, str]) -> frozenset[str]:
    """The classes and the id of an element as selectors name them."""
    return frozenset([f".{c}" for c in given.get("class", "").split()] + ([f"#{given['id']}"] if given.get("id") else []))


def chain(selector: str) -> list[tuple[bool, Simple]] | None:
    """The elements of a selector from the last one outwards, each with whether it is the parent of the one before.

    None for what is not understood, sibling combinators among it.
    """
    out, parent = [], False
    for step in reversed(STEP.findall(selector)):
        if step == ">":
            if parent or not out:
                return None
            parent = True
            continue
        simple = None if step in "+~" else Simple.read(step)
        if simple is None:
            return None
        out.append((parent, simple))
        parent = False
    return None if parent or not out else out


def inside(steps: list[tuple[bool, Simple]], above: Sequence[tuple[str, frozenset[str], dict[str, str]]]) -> bool:
    """Whether the elements ``above``, outermost first, hold the ``steps``.

    Places in ``above`` that the steps so far can have reached are kept together, so no way is tried twice.
    """
    places = {len(above)}
    for parent, simple in steps:
        tried = {i - 1 for i in places if i} if parent else range(max(places))
        places = {i for i in tried if simple.fits(*above[i])}
        if not places:
            return False
    return True


def _feature(text: str) -> bool:
    name, colon, value = (x.strip() for x in text.lower().partition(":"))
    if colon:
        end = re.match(r"(min|max)-(width|height|device-width|device-height)$", name)
        size = SIZE.match(value)
        if end and size:
            wanted, has = float(size[1]) * (EM if size[2] in ("em", "rem") else 1), WIDTH if "width" in end[2] else HEIGHT
            return has >= wanted if end[1] == "min" else has <= wanted
        return FEATURES.get(name) == value
    parts = re.split(r"\s*(<=|>=|<|>|=)\s*", name)
    if len(parts) == 1:
        return name in HAS
    numbers = []
    for p in parts[::2]:
        size = SIZE.match(p)
        if p not in ("width", "height") and not size:
            return False
        numbers.append({"width": WIDTH, "height": HEIGHT}[p] if not size else float(size[1]) * (EM if size[2] in ("em", "rem") else 1))
    holds = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}
    return all(holds[op](a, b) for op, a, b in zip(parts[1::2], numbers, numbers[1:]))


def screen_meets(queries: str) -> bool:
    """Whether a desktop screen meets a list of media queries; what is not understood is not met."""
    if not queries.strip():
        return True
    for query in queries.lower().split(","):
        m = re.match(r"\s*(?:(not|only)\s+)?([a-z-]+)?\s*(.*)$", query, re.S)
        kind, rest = m[2], m[3].strip()
        if kind == "and" or kind is None and not rest:
            continue
        met = kind in (None, "all", "screen")
        if rest:
            terms = re.split(r"\s+(and|or)\s+", re.sub(r"^and\b\s*", "", rest))
            found, known = [], True
            for term in terms[::2]:
                t = re.fullmatch(r"(not\s*)?\(\s*([^()]*?)\s*\)", term.strip())
                known = known and t is not None
                found.append(t is not None and _feature(t[2]) != bool(t[1]))
            if not known:
                continue
            met = met and (any(found) if "or" in terms[1::2] else all(found))
        if met != (m[1] == "not"):
            return True
    return False


def blocks(css: str) -> Iterator[tuple[str, str | None]]:
    """The heads of a style sheet with their blocks; None for a statement without one."""
    at, depth, begin, head = 0, 0, 0, ""
    for m in PIECE.finditer(css):
        c = m[0]
        if c == "{":
            if not depth:
                head, begin = css[at : m.start()].strip(), m.end()
            depth += 1
        elif c == "}":
            depth = max(0, depth - 1)
            if not depth:
                if begin > at or head:
                    yield head, css[begin : m.start()]
                at, begin, head = m.end(), m.end(), ""
        elif c == ";" and not depth:
            if css[at : m.start()].lstrip().startswith("@"):
                yield css[at : m.start()].strip(), None
                at = begin = m.end()
    if depth:  # closed by the sheet's end
        yield head, css[begin:]


def own(body: str) -> str:
    """The declarations of a block without rules nested in it."""
    if "{" not in body:
        return body
    out, at, depth = [], 0, 0
    for m in PIECE.finditer(body):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
            at = m.end() if not depth else at
        elif m[0] == ";" and not depth:
            out.append(body[at : m.end()])
            at = m.end()
    return "".join(out) + ("" if depth else body[at:])


class Styles:
    """Rules by the id, class or tag that an element must have.

    Selectors may ask for tags, classes, ids and attributes, for ``:not`` of these, and for ancestors and parents;
    other selectors (siblings, other pseudo-classes) are left out.
    """

    def __init__(self):
        self.rules: dict[str, list[tuple[list[tuple[bool, Simple]], str, str, Weight]]] = {}
        self.order = 0
        self.nested = False  # whether a rule asks for elements around

    def read(self, css: str) -> None:
        self._read(re.sub(r"/\*.*?(?:\*/|$)|<!--|-->", " ", css, flags=re.S), 0)

    def _read(self, css: str, depth: int) -> None:
        for head, body in blocks(css):
            if head.startswith("@"):
                name, _, condition = re.sub(r"^(@[\w-]+)", r"\1 ", head).partition(" ")
                name, condition = name.lower(), condition.strip()
                if body is None or depth > 20:
                    continue
                if name == "@layer" or name == "@media" and screen_meets(condition) or name == "@supports" and not re.match(r"not\b", condition, re.I):
                    self._read(body, depth + 1)
                continue
            said = list(declarations(own(body or "")))
            if not said:
                continue
            self.order += 1
            for selector in LISTED.findall(head):
                steps = chain(selector)
                if not steps:
                    continue
                self.nested = self.nested or len(steps) > 1
                last = steps[0][1]
                key = min(last.marks) if last.marks else last.tag
                ids, classes, tags = map(sum, zip(*[x.weight() for _, x in steps]))
                for name, value, important in said:
                    self.rules.setdefault(key, []).append((steps, name, value, (important, False, ids, classes, tags, self.order)))

    def decided(self, tag: str, given: dict[str, str], above: Sequence[tuple[str, frozenset[str], dict[str, str]]] = ()) -> dict[str, str]:
        """The values of display, visibility and opacity that rules and inline style give an element below ``above``."""
        best: dict[str, tuple[Weight, str]] = {}
        if self.rules:
            marks = marks_of(given)
            for key in (tag, "*", *marks):
                for steps, name, value, weight in self.rules.get(key, ()):
                    if name in best and weight < best[name][0] or not steps[0][1].fits(tag, marks, given):
                        continue
                    if len(steps) == 1 or inside(steps[1:], above):
                        best[name] = (weight, value)
        for i, (name, value, important) in enumerate(declarations(given.get("style", ""))):
            weight = (important, True, 0, 0, 0, i)
            if name not in best or weight >= best[name][0]:
                best[name] = (weight, value)
        return {name: value for name, (_, value) in best.items()}
