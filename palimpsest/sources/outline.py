"""Provisions of one parsed document in one pass: units, titles, places and the lines of tables.

What :mod:`provisions` tells of elements as rows, told of a document that a task holds whole; so nothing is shuffled or joined for
it, and a task holds one document.
"""

from __future__ import annotations

import re
from collections import Counter

#: Fixed values of the markup: units; subtrees that are no text; elements whose content is text only; elements that open a line;
#: those inside a run of text whose content does; and enumerators, which share their line with what follows.
UNITS = ("ARTICLE", "CONS.ANNEX", "ANNEX")
SKIPPED = ("BIB.INSTANCE",)
INLINE = (
    "TITLE TI STI TI.BLK TI.ART STI.ART NO.PARAG NO.P NO.GR.SEQ NO.ITEM NO.SEQ TERM HT FT IE DATE LINK ADDR IMG.CNT INCL.ELEMENT "
    "INCLUSIONS REF.DOC REF.DOC.OJ QUOT.START QUOT.END TBL NOTE ANNOTATION GR.ANNOTATION TOC TOC.BLK TOC.ITEM ITEM.CONT QUOT.S ARTICLE"
).split()
BLOCKS = (
    "ARTICLE PARAG ALINEA NP TXT LIST ITEM P DLIST DLIST.ITEM TERM DEFINITION ANNEX CONS.ANNEX CONTENTS GR.SEQ TITLE TI STI TI.ART STI.ART "
    "TI.BLK NO.PARAG NO.P NO.GR.SEQ NO.ITEM TBL CORPUS BLK ROW CELL GR.NOTES LOC.NOTES TOC TOC.BLK TOC.ITEM ITEM.CONT ANNOTATION "
    "GR.ANNOTATION ADDR INCL.ELEMENT IMG.CNT"
).split()
DETACHED = ("NOTE", "QUOT.S")
ENUMERATORS = ("NO.PARAG", "NO.P", "NO.GR.SEQ", "NO.ITEM")
#: Marks of an unnumbered point.
DASHES = ("-", "–", "—", "―", "•", "*", "")

_BREAKING = frozenset(BLOCKS) | frozenset(DETACHED)
_INLINE = frozenset(INLINE)


def flattened(root):
    """Rows (pos, end, parent, tag, tags, up, attrs, at, text, tail_at, tail, gap), children before tails, by a stack (documents may be deep).

    ``at`` and ``tail_at`` order all texts; ``gap`` is what stands before an element where its parent has text on the line already.
    """
    rows: list[list] = []
    clock = 0
    # of each open element: its row, its children to come, whether its text so far ends in a line with text, the tag before
    stack: list[list] = []

    def opened(element, gap):
        nonlocal clock
        above = stack[-1][0] if stack else None
        row = [len(rows), None, above[0] if above else None, str(element.tag)]
        row += [above[4] + [above[3]], above[5] + [above[0]]] if above else [[], []]
        row += [dict(element.attrib), clock, element.text, None, None, gap]
        clock += 1
        rows.append(row)
        stack.append([row, iter([c for c in element if isinstance(c.tag, str)]), bool(element.text) and not element.text[-1].isspace(), None, bool(element.text), element])

    opened(root, None)
    while stack:
        row, children, inked, before, some, element = stack[-1]
        child = next(children, None)
        if child is not None:
            gap = None
            if child.tag not in SKIPPED and child.tag in _BREAKING and inked:
                gap = " " if before in ENUMERATORS or child.tag == "CELL" else "\n"
                stack[-1][2] = False
            opened(child, gap)
            continue
        stack.pop()
        row[1] = len(rows) - 1
        row[9], row[10] = clock, element.tail if stack else None
        clock += 1
        if stack:
            outer = stack[-1]
            if some and element.tag not in SKIPPED:
                outer[2], outer[3], outer[4] = inked, element.tag, True
            if element.tail:
                outer[2], outer[3], outer[4] = not element.tail[-1].isspace(), None, True
    return rows


class Node:
    """An element of a unit: its place in the document, the element above it, its unit, and the tags from below the unit down to it."""

    __slots__ = ("pos", "element", "tag", "parent", "unit", "steps", "inline")

    def __init__(self, pos, element, parent, unit, steps, inline):
        self.pos, self.element, self.tag, self.parent, self.unit, self.steps, self.inline = pos, element, element.tag, parent, unit or self, steps, inline


def nodes(root, closed: tuple[str, ...] = ()):
    """The nodes of a document's units in document order; what is below an element of ``closed`` is left out.

    A unit is the first unit's tag on the way down, unless the way leads through text or a skipped subtree. Skipped subtrees have none.
    """
    pos, stack = 0, [(root, None)]
    while stack:
        element, parent = stack.pop()
        tag, node = element.tag, None
        leave = tag in closed or (element is not root and tag in SKIPPED)
        if parent is not None:
            if tag not in SKIPPED:
                node = Node(pos, element, parent, parent.unit, (*parent.steps, tag), parent.inline or tag in _INLINE)
        elif tag in UNITS:
            node = Node(pos, element, None, None, (), False)
        elif element is not root and tag in _INLINE:
            leave = True
        if node is not None:
            yield node
        if leave:
            pos += sum(1 for _ in element.iter())
            continue
        pos += 1
        stack.extend((child, node) for child in reversed(element))


def texts(element, left_out: tuple[str, ...] = ()) -> list[str]:
    """The texts of an element in order, without those inside elements of ``left_out``; what stands behind such an element stays."""
    out, stack = [element.text], [(None, iter(element))]
    while stack:
        opened, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if opened is not None:
                out.append(opened.tail)
        elif child.tag in SKIPPED:
            continue
        elif child.tag in left_out:
            out.append(child.tail)
        else:
            out.append(child.text)
            stack.append((child, iter(child)))
    return [t for t in out if t]


def flat(element, left_out: tuple[str, ...] = ()) -> str:
    """The comparison text of an element: a blank at every element's border, white space collapsed."""
    return " ".join(" ".join(texts(element, left_out)).split())


def shown(element) -> str:
    """The text of an element as the document has it, with line breaks where a block opens."""
    if not len(element):
        return element.text or ""
    pieces = []
    for pos, _, _, tag, tags, _, _, at, text, tail_at, tail, gap in flattened(element):
        if tag in SKIPPED or not set(SKIPPED).isdisjoint(tags):
            continue
        pieces += [(at, 1, text), (tail_at, 1, tail)]
        if pos:
            pieces.append((at, 0, gap))
    return "".join(p[2] for p in sorted((p for p in pieces if p[2]), key=lambda p: p[:2]))


def title(element, name: str) -> str | None:
    """The flat text of the first child of this tag; ``TITLE/TI`` and ``TITLE/STI`` stand below a title."""
    outer, _, inner = name.partition("/")
    for child in element:
        if child.tag == outer:
            if not inner:
                return flat(child)
            for below in child:
                if below.tag == inner:
                    return flat(below)
    return None


def titled(element, *names: str) -> str:
    """The first title of these names that an element has; empty if none."""
    return next((t for t in (title(element, n) for n in names) if t is not None), "")


def identifier(raw: str | None) -> str | None:
    """An identifier attribute as a number: its last dotted part without leading zeros, a letter in small; else null."""
    found = re.search("^([0-9]+)([A-Za-z]*)$", raw.strip(" ").rsplit(".", 1)[-1]) if raw is not None else None
    return (found[1].lstrip("0") or "0") + found[2].lower() if found else None


def annex_number(text: str, word: str) -> str | None:
    """The first number behind ``word`` in a title: a numeral in capitals, or digits with a letter or none."""
    behind = re.findall(rf"\b{word} +([0-9A-Z_a-z]+)", text.upper())
    return next((w for w in behind if re.search("^([CDILMVX]+|[0-9]+[A-Z]?)$", w)), None)


def section_number(text: str) -> str | None:
    """The number of a section by its title: what stands behind ``Section``, or a dotted number before more words."""
    words, found = text.split(" "), None
    if words[0] in ("Section", "SECTION") and len(words) > 1:
        found = re.search("^[0-9A-Za-z.]*", words[1])[0]
    if not found and len(words) > 1 and re.search(r"^[0-9]+(\.[0-9]+)*\.$", words[0]):
        found = words[0]
    return (found or "").rstrip(".") or None


def point(marker: str) -> tuple[str, str | None] | None:
    """(code, value) of a point by its mark: an indent, a number, or a lettered one, which its list may turn to ``PTI``."""
    if marker == "":
        return None
    if marker in DASHES:
        return "TIRE", None
    bare = marker.removesuffix(".")
    bare = bare.removeprefix("(").removesuffix(")")
    if re.search("^[0-9]+[A-Za-z]*$", bare):
        return "PO", bare
    return ("PTA", f"({bare.lower()})") if re.search("^[0-9A-Za-z]+$", bare) else None


def article_number(element) -> str | None:
    """An article's number: by its identifier, or else by its heading."""
    number = identifier(element.get("IDENTIFIER"))
    if number is None:
        headed = re.search(r"\barticle +([0-9]+ ?[a-z]?)(?![0-9A-Z_a-z])", titled(element, "TI.ART").lower())
        number = headed[1].replace(" ", "") if headed else None
    return number


def segment(node: Node) -> tuple[str, str | None] | None:
    """(code, value) that a node adds to a location; null if nothing, a null value if it is counted among its siblings."""

    def of(code: str, value: str | None):
        return None if value is None else (code, value)

    def undotted(text: str) -> str | None:
        return text.strip(" ").rstrip(".") or None

    element, tag, is_unit, annex = node.element, node.tag, node.unit is node, node.unit.tag != "ARTICLE"
    if is_unit and tag == "ARTICLE":
        return of("AR", article_number(element))
    if is_unit or (annex and tag in UNITS):
        text = titled(element, "TITLE/TI", "TITLE")
        return of("AN", annex_number(text, "ANNEX")) or of("APP", annex_number(text, "APPENDIX"))
    if tag == "PARAG":
        number = identifier(element.get("IDENTIFIER"))
        lettered = undotted(titled(element, "NO.PARAG"))
        return of("PA", number if number is not None else lettered and lettered.lower())
    if tag == "ALINEA":
        return "ALN", None
    if tag == "NP":
        return point(titled(element, "NO.P").strip(" "))
    if annex and tag == "GR.SEQ":
        return of("SCT", undotted(titled(element, "NO.GR.SEQ")) or section_number(titled(element, "TITLE/TI", "TITLE")))
    return None


class Places:
    """Locations of one unit's elements, given in document order.

    An element without a segment, or whose location is taken, is passed through: what is below it belongs to the node above.
    """

    def __init__(self):
        self.held: dict[int, tuple[str, dict, str | None]] = {}

    def above(self, pos: int | None) -> str:
        """The location that what stands below ``pos`` is part of."""
        return self.held.get(pos, ("",))[0]

    def add(self, pos: int, parent: int | None, tag: str, list_type: str | None, code: str | None, value: str | None) -> tuple[str, str | None] | None:
        """(location, the location above) of an element; null if it has none."""
        where, scope, kind = self.held.get(parent, ("", {"n": Counter(), "taken": set()}, None))
        if code == "PTA" and isinstance(kind, str) and kind.lower() == "roman":
            code = "PTI"
        kind = list_type if tag == "LIST" else kind
        if isinstance(code, str):
            if not isinstance(value, str):
                scope["n"][code] += 1
                value = str(scope["n"][code])
            here = f"{where} {code} {value}".strip()
            if here not in scope["taken"]:
                scope["taken"].add(here)
                self.held[pos] = (here, {"n": Counter(), "taken": set()}, None)
                return here, where or None
        self.held[pos] = (where, scope, kind)
        return None


def _number(raw: str | None, least: int) -> int:
    return max(least, int(raw)) if isinstance(raw, str) and raw.strip().isdigit() else least


def grid(rows: list[list[tuple]], columns: int) -> list[tuple[list[str], list[str]]]:
    """(cells, marks) of each line of a table, from the cells (col, across, down, text) of its rows in order.

    A mark tells how a place was filled: empty by a cell, ``C`` across, ``R`` by a cell further up, ``-`` by nothing. A cell down
    several rows shows its text in each, at its first column; a later one at the same column takes its place for good.
    """
    spans: dict[int, tuple[int, str]] = {}  # column -> the last row that it reaches, its text
    lines, width = [], columns
    for row, own in enumerate(rows, 1):
        line = {c: (text, "R") for c, (last, text) in spans.items() if last >= row}
        free = 1
        for col, over, under, text in own:
            at = _number(col, 0)
            while at == 0:
                at = 0 if free in line else free
                free += at == 0
            across, down = _number(over, 1), _number(under, 1)
            line[at] = (text, "")
            if across > 1:
                line |= {at + k: ("", "C") for k in range(1, across)}
            if down > 1:
                spans |= {at + k: (row + down - 1, text if k == 0 else "") for k in range(across)}
            free = at + across
        lines.append(line)
        width = max([width, *line])
    nothing = ("", "-")
    places = range(1, width + 1)
    full = ([line.get(c, nothing) for c in places] for line in lines)
    return [([p[0] for p in line], [p[1] for p in line]) for line in full]


def _rows(table) -> list[tuple]:
    """(row element, heading) of a table's rows; ``heading`` is the title of the innermost block around a row, null if none has one."""
    out, stack = [], [(c, None) for c in reversed(table) if c.tag == "CORPUS"]
    while stack:
        element, heading = stack.pop()
        if element.tag == "ROW":
            out.append((element, heading))
            continue
        if element.tag == "BLK":
            heading = next((shown(c) for c in element if c.tag == "TI.BLK"), heading)
        stack.extend((c, heading) for c in reversed(element) if c.tag in ("BLK", "ROW"))
    return out


def table_lines(root):
    """(unit, container, table, row, header, heading, cells, marks): the lines of every table of a document's numbered units.

    ``container`` is the location of the node that a table stands in, ``table`` its number there; a table inside a table is part of
    the outer one.
    """
    for node in nodes(root, ("TBL",)):
        if node.unit is node:
            places, counted, own = Places(), Counter(), segment(node)
            if own is not None:
                places.add(node.pos, None, node.tag, None, *own)
        elif own is None:
            continue  # of a unit without a number
        elif node.tag == "TBL":
            above = node.parent
            while above.inline:
                above = above.parent
            container = places.above(above.pos)
            counted[container] += 1
            rows = _rows(node.element)
            cells = [[(c.get("COL"), c.get("COLSPAN"), c.get("ROWSPAN"), shown(c)) for c in row if c.tag == "CELL"] for row, _ in rows]
            for at, ((row, heading), line) in enumerate(zip(rows, grid(cells, _number(node.element.get("COLS"), 0))), 1):
                yield node.unit.pos, container, counted[container], at, row.get("TYPE") == "HEADER", heading, *line
        elif not node.inline:
            places.add(node.pos, node.parent.pos, node.tag, node.element.get("TYPE"), *(segment(node) or (None, None)))
