"""What a page's style rules say of display and visibility: sheets, media, selectors, and which declaration wins.

Selectors of elements, classes, ids and attributes, with descendants and children, are matched; a rule whose selector says
more (states such as :hover, siblings, pseudo-elements) is left out, so it hides nothing. A screen of WIDTH pixels is assumed.
"""

from __future__ import annotations

import re

WIDTH = 1280
#: Comments and scripts are passed over; the group is a style element's body.
STYLES = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<script\b.*?(?:</script|\Z)|<style\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)(?:</style|\Z)", re.S | re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
MEDIA_ATTRIBUTE = re.compile(r"\bmedia\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
FEATURE = re.compile(r"\(\s*(min|max)-width\s*:\s*([\d.]+)\s*(px|em|rem)\s*\)")
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\])*)")
MARK = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]")


class Element:
    """An open element, as selectors see it."""

    def __init__(self, name: str, given: dict[str, str], parent: "Element | None"):
        self.name, self.given, self.parent = name, given, parent
        self.id, self.classes = given.get("id", ""), frozenset(given.get("class", "").split())


def for_screens(query: str) -> bool:
    """Whether a media query list holds for a screen of WIDTH pixels; a feature that isn't known doesn't."""
    return not query.strip() or any(_holds(q.strip().lower()) for q in query.split(","))


def _holds(query: str) -> bool:
    if turned := query.startswith("not "):
        query = query[4:]
    query = query.removeprefix("only ")
    good = True
    for part in re.split(r"\s+and\s+", query):
        if m := FEATURE.fullmatch(part):
            size = float(m[2]) * (1 if m[3] == "px" else 16)
            good &= WIDTH >= size if m[1] == "min" else WIDTH <= size
        else:
            good &= part in ("screen", "all")
    return good != turned


def declared(body: str) -> list[tuple[str, bool, bool]]:
    """(property, shown, important) of a rule's or attribute's declarations, in order."""
    found = []
    for m in DECLARATION.finditer(body):
        name, value = m[1].lower(), m[2].lower()
        if name == "display":
            found.append((name, value != "none", bool(m[3])))
        elif value in ("visible", "hidden", "collapse"):
            found.append((name, value == "visible", bool(m[3])))
    return found


def _compound(text: str) -> tuple | None:
    m = COMPOUND.fullmatch(text)
    if not m or not text:
        return None
    classes, ids, attributes = [], [], []
    for k in MARK.finditer(m[2]):
        if k[3]:
            attributes.append((k[3].lower(), next((x for x in k.groups()[3:] if x is not None), None)))
        else:
            (classes if k[1] == "." else ids).append(k[2])
    name = "" if m[1] in (None, "*") else m[1].lower()
    return name, frozenset(classes), ids, attributes, (len(ids), len(classes) + len(attributes), int(bool(name)))


def _fits(compound: tuple, element: Element) -> bool:
    name, classes, ids, attributes, _ = compound
    return (not name or name == element.name) and classes <= element.classes and all(i == element.id for i in ids) and all(k in element.given and (v is None or element.given[k] == v) for k, v in attributes)


class Selector:
    def __init__(self, text: str):
        parts = re.findall(r">|[^\s>]+(?:\[[^\]]*\])?", re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"\s+", "", m[0]), text))
        self.steps: list[tuple[str, tuple]] = []  # from the element itself to its ancestors: (how it is reached, compound)
        how, self.good = "", bool(parts) and parts[0] != ">" and parts[-1] != ">"
        for part in reversed(parts):
            if part == ">":
                self.good &= how != ">"
                how = ">"
                continue
            compound = _compound(part)
            self.good &= compound is not None
            self.steps.append((how, compound))
            how = " "
        self.weight = tuple(sum(x) for x in zip(*(c[4] for _, c in self.steps), strict=True)) if self.good else ()

    def fits(self, element: Element) -> bool:
        return _fits(self.steps[0][1], element) and self._above(1, element.parent)

    def _above(self, k: int, element: Element | None) -> bool:
        if k == len(self.steps):
            return True
        how, compound = self.steps[k]
        while element is not None:
            if _fits(compound, element) and self._above(k + 1, element.parent):
                return True
            if how == ">":
                return False
            element = element.parent
        return False


class Sheet:
    """A page's rules on display and visibility."""

    def __init__(self) -> None:
        #: By a mark that the element must have: (selector, place in the sheets, declarations).
        self.rules: dict[str, list[tuple[Selector, int, list]]] = {}
        self.count = 0

    def read_page(self, source: str) -> None:
        if "<style" not in source and "<STYLE" not in source and not re.search("<style", source, re.I):
            return
        for m in STYLES.finditer(source):
            if m[2] is not None:
                media = MEDIA_ATTRIBUTE.search(m[1])
                if not media or for_screens(media[1] or media[2] or media[3] or ""):
                    self.read(COMMENT.sub(" ", m[2]))

    def read(self, body: str) -> None:
        """Rules of a sheet, and of the blocks in it that hold for screens."""
        at = 0
        while (start := body.find("{", at)) >= 0:
            head = re.sub(r"^(?:[^{]*;)", "", body[at:start]).strip()
            depth, end = 1, start + 1
            while depth and (m := re.compile("[{}]").search(body, end)):
                depth += 1 if m[0] == "{" else -1
                end = m.end()
            inner = body[start + 1 : end - 1 if not depth else len(body)]
            at = end if not depth else len(body)
            if head.startswith("@"):
                kind, _, query = head[1:].partition(" ")
                kind = kind.lower()
                if kind == "media" and for_screens(query) or kind == "layer" or kind == "supports" and not query.strip().lower().startswith("not"):
                    self.read(inner)
            elif said := declared(inner):
                self.count += 1
                for text in head.split(","):
                    selector = Selector(text.strip())
                    if selector.good:
                        name, classes, ids, *_ = selector.steps[0][1]
                        key = f"#{ids[0]}" if ids else f".{min(classes)}" if classes else name
                        self.rules.setdefault(key, []).append((selector, self.count, said))

    def look(self, element: Element | None, given: dict[str, str]) -> tuple[bool | None, bool | None]:
        """(display, visibility) of an element: shown, not shown, or None where nothing says."""
        best: dict[str, tuple] = {}

        def weigh(said: list, weight: tuple, place: int) -> None:
            for k, (name, shown, important) in enumerate(said):
                rank = (important, weight, place, k)
                if name not in best or rank >= best[name][0]:
                    best[name] = (rank, shown)

        if element is not None:
            for key in (f"#{element.id}", *(f".{c}" for c in element.classes), element.name, ""):
                for selector, place, said in self.rules.get(key, ()):
                    if selector.fits(element):
                        weigh(said, (0, *selector.weight), place)
        if given.get("style"):
            weigh(declared(COMMENT.sub(" ", given["style"])), (1, 0, 0, 0), 0)
        return tuple(best[n][1] if n in best else None for n in ("display", "visibility"))
