"""Drawn web pages with known main text, to train and test the labelling of blocks."""

from __future__ import annotations

import numpy as np

#: Parts of invented words, and words that stand outside the main text of many pages.
SYLLABLES = (
    "the and er on in re en th an ti es ou st or ed nd at ha he ing sh ly ble tion que ment eau oi an ai le la de vi pa "
    "ción ado mente ie os as ar sch ein ich ung ver ge ß ä ü ö é è ç ê ou eux tre ier".split()
)
CHROME = (
    "home about contact login register search menu share tweet print subscribe newsletter cookies accept privacy terms "
    "policy advertisement sponsored copyright rights reserved reply comments comment posted by tags related more read "
    "next previous popular latest follow sign up email password submit cart help sitemap language settings skip to "
    "content categories archives trending recommended you may also like consent".split()
)
TITLES = "article post entry story content text body main page single blog news document".split()
#: Element and class of each kind of page part that is no main text.
PARTS = {
    "menu": [("nav", ""), ("nav", "main-nav"), ("div", "menu"), ("ul", "menu"), ("div", "navbar"), ("div", "navigation"), ("div", "topbar"), ("ul", ""), ("div", "breadcrumb"), ("div", "nav-links")],
    "header": [("header", ""), ("div", "header"), ("div", "site-header"), ("header", "masthead"), ("div", "logo"), ("div", "branding"), ("div", "")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "site-footer"), ("footer", "bottom"), ("div", "copyright"), ("div", "legal"), ("div", "")],
    "side": [("aside", ""), ("div", "sidebar"), ("aside", "sidebar widget"), ("div", "widget"), ("div", "related"), ("div", "side-column"), ("section", "recommended"), ("div", "popular")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("aside", "ad"), ("div", "sponsored"), ("div", "promo"), ("div", "banner"), ("section", "sponsor"), ("p", "ad"), ("div", "ad-slot")],
    "notice": [("div", "cookie-notice"), ("div", "cookie"), ("div", "notice"), ("div", "consent"), ("div", "alert"), ("div", "popup"), ("div", "modal"), ("dialog", ""), ("div", "gdpr-banner"), ("p", "notice"), ("div", "subscribe"), ("div", "newsletter"), ("div", "paywall")],
    "form": [("form", ""), ("form", "search"), ("form", "newsletter"), ("form", "login"), ("form", "contact")],
    "comments": [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "replies"), ("section", "discussion"), ("div", "reader-comments"), ("div", "responses")],
    "share": [("div", "share"), ("div", "social"), ("ul", "share-buttons"), ("div", "meta"), ("div", "tags"), ("div", "byline"), ("div", "pagination"), ("div", "toolbar")],
}


class Page:
    """A page under construction: markup, and for each block with text whether it is main text."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.markup, self.labels = rng, [], []
        self.words = ["".join(rng.choice(SYLLABLES, rng.integers(1, 5))) for _ in range(80)]
        self.loud = rng.random() < 0.1  # every word with marks behind it

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def prose(self, low: int, high: int) -> str:
        """Sentences of invented words, about ``low`` to ``high`` words, short ones more often."""
        count = int(low * (high / low) ** self.rng.random())
        words = [str(w) for w in self.rng.choice(self.words, count)]
        for k in range(count):
            if self.chance(0.05):
                words[k] += ","
            if k == count - 1 or self.chance(0.08):
                words[k] += str(self.rng.choice([".", ".", ".", "!", "?"]))
            if k == 0 or words[k - 1][-1] in ".!?":
                words[k] = words[k].capitalize()
            if self.loud:
                words[k] += str(self.rng.choice(["###", "***", "%%%", "&amp;&amp;", "$$$"]))
        return " ".join(words)

    def label_words(self, low: int, high: int) -> str:
        own = self.rng.choice(CHROME if self.chance(0.6) else self.words, self.rng.integers(low, high + 1))
        text = " ".join(map(str, own))
        return text.capitalize() if self.chance(0.5) else text

    def leaf(self, tag: str, text: str, main: bool, attributes: str = "", closed: bool = True) -> None:
        self.markup.append(f"<{tag}{attributes}>{text}" + (f"</{tag}>" if closed else ""))
        self.labels.append(main)

    def link(self, text: str) -> str:
        return f'<a href="/{text[:12]}">{text}</a>'

    def open(self, tag: str, classes: str) -> str:
        name = str(self.rng.choice(["class", "class", "class", "id"]))
        self.markup.append(f'<{tag} {name}="{classes}">' if classes else f"<{tag}>")
        return f"</{tag}>"

    def links(self, low: int, high: int) -> None:
        listed = self.chance(0.7)
        if listed:
            self.markup.append("<ul>")
        for _ in range(self.rng.integers(low, high + 1)):
            self.leaf("li" if listed else "p", self.link(self.label_words(1, 3)), False)
        if listed:
            self.markup.append("</ul>")

    def part(self, kind: str) -> None:
        """One part that is no main text."""
        options = PARTS[kind]
        tag, classes = options[self.rng.integers(len(options))]
        end = self.open(tag, classes)
        if kind == "menu":
            if tag == "ul":
                for _ in range(self.rng.integers(3, 9)):
                    self.leaf("li", self.link(self.label_words(1, 2)), False)
            else:
                self.links(3, 9)
        elif kind == "header":
            self.leaf(str(self.rng.choice(["p", "div", "h1", "h2"])), self.label_words(1, 4), False)
            if self.chance(0.4):
                self.links(2, 6)
        elif kind == "footer":
            end_text = "&copy; " + (f"{self.label_words(1, 2)}.example.com &middot; {self.prose(4, 14)}" if self.chance(0.6) else self.label_words(2, 6))
            if self.chance(0.5):
                self.markup.append(end_text)
                self.labels.append(False)
            else:
                self.leaf("p", end_text, False)
            if self.chance(0.4):
                self.links(2, 6)
        elif kind == "side":
            self.leaf(str(self.rng.choice(["h2", "h3", "h4"])), self.label_words(1, 3), False)
            if self.chance(0.4):
                self.leaf("p", self.prose(8, 40), False)
            self.links(2, 7)
        elif kind in ("advert", "notice"):
            text = self.prose(4, 40) if self.chance(0.7) else self.label_words(3, 8)
            if self.chance(0.6) or tag == "p":
                self.markup.append(text)
                self.labels.append(False)
            else:
                self.leaf("p", text, False)
            if tag != "p" and self.chance(0.3):
                self.leaf("p", self.link(self.label_words(1, 3)), False)
            if tag != "p" and kind == "notice" and self.chance(0.4):
                self.leaf("button", self.label_words(1, 2), False)
        elif kind == "form":
            for _ in range(self.rng.integers(1, 4)):
                self.leaf("label", self.label_words(1, 3), False)
                self.markup.append('<input type="text" name="q">')
            if self.chance(0.3):
                self.leaf("p", self.prose(5, 25), False)
            if self.chance(0.8):
                self.leaf("button", self.label_words(1, 2), False)
        elif kind == "comments":
            if self.chance(0.7):
                self.leaf("h3", self.label_words(1, 3), False)
            for _ in range(self.rng.integers(1, 7)):
                inner = self.open("li" if tag == "ol" else "div", str(self.rng.choice(["comment", "reply", "comment-body", ""])))
                if self.chance(0.6):
                    self.leaf("div", self.label_words(1, 3), False)
                self.leaf("p", self.prose(4, 80), False)
                self.markup.append(inner)
        else:
            for _ in range(self.rng.integers(1, 4)):
                self.leaf("div" if tag != "ul" else "li", self.link(self.label_words(1, 2)) if self.chance(0.6) else self.label_words(1, 4), False)
        self.markup.append(end)

    def story(self) -> None:
        """Blocks of main text, now and then broken by a part that is none."""
        ragged = self.chance(0.3)
        if self.chance(0.85):
            self.leaf("h1", self.prose(3, 12), True)
        if self.chance(0.25):
            self.part("share")
        for k in range(int(np.exp(self.rng.uniform(0, 3.4)))):
            draw = self.rng.random()
            if ragged and (k == 0 or draw < 0.15):
                self.leaf("p", "<b>" + self.prose(1, 60) + "<br>", True, closed=False)
            elif draw < 0.74:
                self.leaf("p", self.prose(1, 180) if self.chance(0.9) else self.prose(5, 20) + " " + self.link(self.prose(1, 4)), True)
            elif draw < 0.82:
                self.leaf(str(self.rng.choice(["h2", "h3", "h4"])), self.prose(1, 8), True)
            elif draw < 0.88:
                kind = str(self.rng.choice(["ul", "ol"]))
                self.markup.append(f"<{kind}>")
                for _ in range(self.rng.integers(2, 6)):
                    self.leaf("li", self.prose(1, 20), True)
                self.markup.append(f"</{kind}>")
            elif draw < 0.92:
                self.markup.append("<blockquote>")
                self.leaf("p", self.prose(4, 40), True)
                self.markup.append("</blockquote>")
            elif draw < 0.94:
                self.markup.append("<table>")
                for _ in range(self.rng.integers(1, 4)):
                    self.markup.append("<tr>")
                    for _ in range(2):
                        self.leaf("td", self.prose(1, 6), True)
                    self.markup.append("</tr>")
                self.markup.append("</table>")
            elif draw < 0.955:
                self.markup.append('<figure><img src="x.png">')
                self.leaf("figcaption", self.prose(2, 12), True)
                self.markup.append("</figure>")
            elif draw < 0.965:
                self.leaf("pre", self.prose(3, 30), True)
            else:
                self.part(str(self.rng.choice(["advert", "advert", "notice", "side", "share", "form"])))


def sample_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """(html, whether each block is main text) of a drawn page: main text between and around other parts."""
    page = Page(rng)
    page.markup.append("<!DOCTYPE html><html><head>")
    if page.chance(0.9):
        page.leaf("title", page.prose(2, 12), False)
    page.markup.append("<style>p{margin:0}</style><script>var t=\"</p>\";</script></head><body>")
    for kind, share in (("notice", 0.25), ("header", 0.45), ("menu", 0.85), ("form", 0.15), ("advert", 0.45), ("side", 0.15)):
        if page.chance(share):
            page.part(kind)
    ends = []
    if page.chance(0.4):
        ends.append(page.open("div", str(rng.choice(["container", "wrapper", "layout", "page", ""]))))
    if page.chance(0.35):
        ends.append(page.open("main", ""))
    if page.chance(0.65):
        ends.append(page.open("article", "" if page.chance(0.6) else str(rng.choice(TITLES))))
    elif page.chance(0.8):
        ends.append(page.open(str(rng.choice(["div", "section"])), "-".join(map(str, rng.choice(TITLES, rng.integers(1, 3))))))
    inside = int(rng.integers(0, len(ends) + 1))
    if page.chance(0.96):
        page.story()
    for k, end in enumerate(reversed(ends)):
        if k == inside:
            after(page)
        page.markup.append(end)
    if inside == len(ends):
        after(page)
    if page.chance(0.8):
        page.part("footer")
    if page.chance(0.8):
        page.markup.append("</body></html>")
    return "".join(page.markup), page.labels


def after(page: Page) -> None:
    for kind, share in (("share", 0.3), ("comments", 0.45), ("side", 0.4), ("advert", 0.3), ("form", 0.15), ("notice", 0.1)):
        if page.chance(share):
            page.part(kind)
