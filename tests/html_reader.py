"""Another reading of HTML, tag by tag, to compare the library with."""

from html.parser import HTMLParser

TAGS = {**{f"h{n}": ("heading", n) for n in range(1, 7)}, "p": ("paragraph", 0), "blockquote": ("quote", 0), "li": ("list", 0), "table": ("table", 0), "pre": ("code", 0), "figcaption": ("figure", 0)}
HOLDERS, DROPPED = ("blockquote", "table", "pre", "li"), ("script", "style", "nav")


class HtmlReader(HTMLParser):
    """Block tags outside quotes, tables, code and list items; an unclosed paragraph ends at the next one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, int]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.dropped, self.all, self.in_body = 0, [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":
            self.in_body, self.all = True, []
        if tag in DROPPED:
            self.dropped += 1
        if tag in TAGS and self.open and self.open[-1][0] == "p" and tag != "figcaption":
            self.handle_endtag("p")
        if tag in TAGS and not any(t in HOLDERS for t, _ in self.open):
            self.open.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        if any(t == tag for t, _ in self.open):
            while True:
                name, words = self.open.pop()
                if words:
                    self.blocks.append((TAGS[name][0], " ".join(words), TAGS[name][1]))
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        words = data.split()
        if words and not self.dropped:
            self.all += words
            for _, own in self.open:
                own += words


def html_items(text: str | None) -> list[tuple[str, str, int]]:
    reader = HtmlReader()
    reader.feed(text or "")
    reader.close()
    while reader.open:
        reader.handle_endtag(reader.open[-1][0])
    return reader.blocks or ([("paragraph", " ".join(reader.all), 0)] if reader.all else [])
