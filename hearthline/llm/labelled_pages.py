"""Labelled pages for the extraction model, laid out from pages that say themselves what is what.

Pages that mark their article with <article> or <main>, and what surrounds it with <nav>, <footer>
and the like, label their own blocks. From a bounded sample of them, texts of both kinds are set
anew into layouts of many shapes: other containers, class names, sidebars, notices, adverts,
forms and reader comments, before, after and inside the article. So the model learns what the
marks mean, and does not depend on one site's markup. Texts that the sample lacks, such as
comments, are made from sentences of its articles, so that wording alone does not give them away.

The phrases and class names below are examples for training. They are no rules: nothing is
extracted or dropped by looking them up.
"""

from __future__ import annotations

import random
from html import escape

from hearthline.llm.dom import Block, blocks

MAIN, OTHER = 1, 0
#: Labelled pages have at most so many blocks and characters of text, and layouts so many
#: paragraphs; longer ones would outweigh the rest of the bounded sample.
MOST_BLOCKS, MOST_CHARS, MOST_PARAGRAPHS = 400, 100_000, 25
#: With fewer labelled pages the example sentences and phrases take part in the layouts.
ENOUGH_PAGES = 50
INSIDE = {"article", "main"}
OUTSIDE = {"nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "noscript"}

PROSE = ("The council met on Tuesday to discuss the new bridge. Work is expected to begin in spring, and the budget has grown. "
         "Residents asked how long the road would be closed. Nobody could say for certain. A second hearing is planned for May. "
         "The river has risen twice this year. Engineers measured the old pillars and found small cracks in three of them.").split(". ")

#: Fixed examples: class names and short texts of the parts of a page that are no article.
SURROUNDINGS = {
    "menu": ("nav menu navbar navigation main-nav top-menu site-menu breadcrumb breadcrumbs tabs pagination pager toc",
             "Home|About us|Contact|News|Sport|Shop|Next page|Previous|Archive|Login|Menu|Skip to content|Startseite|Accueil|Inicio"),
    "header": ("header site-header masthead topbar banner branding logo site-title page-header tagline",
               "The Daily Post|All the news since 1902|Search|Subscribe now|Welcome back|My account|Your news every day"),
    "footer": ("footer site-footer bottom copyright colophon legal credits page-footer imprint",
               "© 2024 All rights reserved.|Privacy policy|Terms of use|Imprint|© example.net · Contact us|Powered by our readers"),
    "sidebar": ("sidebar side aside widget related related-posts more-stories recommended popular trending tags tag-list archive-list",
                "Most read|Related articles|You may also like|Recent posts|Popular tags|More from this author|Follow us"),
    "notice": ("cookie cookie-notice cookie-banner consent gdpr notice alert popup modal overlay toast message paywall disclaimer",
               "We use cookies to improve your experience.|Accept all|By continuing you agree to our use of cookies.|"
               "You have 2 free articles left this month.|This site uses cookies. Learn more|Notice: planned maintenance tonight."),
    "advert": ("ad ads advert advertisement adsbygoogle ad-slot sponsored sponsor promo promoted promotion banner-ad commercial",
               "Advertisement|Sponsored content|Buy now and save 20 %!|Limited offer: free delivery|Ad|Anzeige|Publicité"),
    "form": ("form newsletter subscribe signup sign-up login search-form contact-form poll survey comment-form",
             "Your e-mail address|Sign up|Subscribe to our newsletter|Send|Password|Search this site|Leave a reply|Name|Submit"),
    "comments": ("comments comment comment-list comment-body discussion replies responses reader-comments disqus feedback user-comment",
                 "3 comments|Reply|Great article, thanks!|Anonymous says:|I do not agree with this at all.|Leave a comment|Report|"
                 "Posted by reader42 on May 3|First!"),
    "share": ("share social share-buttons sharing social-links toolbar tools actions print-links",
              "Share on Facebook|Tweet|Print this page|E-mail|Share|Copy link|Like"),
}
ARTICLE_NAMES = ("article post content entry entry-content post-content article-body story story-body main-content text body-text "
                 "hentry page-content post-body article-content blog-post maintext").split()


def tags_of(path: str) -> list[str]:
    return [e.split(">", 1)[0] for e in path.split("/")[1:]]


NAMES_OUTSIDE = frozenset(n for names, _ in SURROUNDINGS.values() for n in names.split()) - {"header", "banner"}


def own_labels(found: list[Block]) -> list[int] | None:
    """Labels by the page's own marks; None for pages without an <article> or <main>, and for
    those with parts inside it that only their class names tell from the article."""
    labels = []
    for block in found:
        elements = block.path.split("/")[1:]
        tags = tags_of(block.path)
        inside = [i for i, t in enumerate(tags) if t in INSIDE]
        labels.append(int(bool(inside) and not OUTSIDE & set(tags[inside[0]:])))
        if labels[-1] and any(NAMES_OUTSIDE & set(e.split(">", 1)[-1].lower().split()) for e in elements):
            return None
    return labels if any(labels) else None


class Layouts:
    """Pages of random shape, with the label of every block, in page order."""

    def __init__(self, seed: int, articles: list[list[str]], others: list[str]):
        self.rng = random.Random(seed)
        few = len(articles) < ENOUGH_PAGES
        self.articles = [a for a in articles if a] + [[s + "." for s in PROSE]] * few
        self.others = others + [t for _, texts in SURROUNDINGS.values() for t in texts.split("|")] * (few or not others)
        self.sentences = [s for a in self.articles for p in a[:40] for s in p.split(". ") if s.strip()] or PROSE

    def some(self, choices):
        return self.rng.choice(choices)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def prose(self) -> str:
        return ". ".join(self.some(self.sentences).strip(" .") for _ in range(self.rng.randrange(1, 5))) + "."

    def leaf(self, tag: str, text: str, link: bool = False) -> str:
        body = escape(text, quote=False)
        if link:
            body = f'<a href="/x">{body}</a>'
        elif self.chance(0.15) and " " in body and "&" not in body:
            head, rest = body.split(" ", 1)
            body = self.some([f"<b>{head}</b> {rest}", f"<em>{head}</em> {rest}", f'<a href="/y">{head}</a> {rest}', f"{head} {rest}<br>"])
        return f"<{tag}>{body}</{tag}>"

    def surrounding(self, kind: str) -> str:
        """A part of a page that is no article."""
        names, phrases = SURROUNDINGS[kind]
        name, phrases = self.some(names.split()), phrases.split("|")
        wrapper = self.some({"menu": ["nav", "nav", "div", "menu", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"],
                             "sidebar": ["aside", "aside", "div", "section"], "form": ["form", "form", "div"],
                             "notice": ["div", "section", "dialog", "p", "aside"], "advert": ["div", "aside", "ins", "section"],
                             "comments": ["section", "div", "ol", "aside"], "share": ["div", "ul", "p"]}[kind])
        mark = self.some([f' class="{name}"', f' class="box {name}"', f' id="{name}"', f' class="{name} js-{self.rng.randrange(9)}"'])
        if wrapper in ("nav", "header", "footer", "aside", "form", "dialog") and self.chance(0.6):
            mark = ""
        texts = [self.some(phrases) for _ in range(self.rng.randrange(1, 5))]
        if kind in ("advert", "notice", "sidebar", "comments", "footer") and self.chance(0.65):
            texts += [self.prose() if self.chance(0.7) else self.some(self.others) for _ in range(self.rng.randrange(1, 4))]
        if kind in ("footer", "advert", "header", "menu") and self.chance(0.5):
            texts = [self.some(self.others) for _ in range(self.rng.randrange(1, 4))]
        self.rng.shuffle(texts)
        if wrapper == "p":
            inner = escape(" ".join(texts), quote=False)
        elif wrapper in ("ul", "ol", "menu"):
            inner = "".join(self.leaf("li", t, kind == "menu" or self.chance(0.2)) for t in texts)
        elif kind == "menu":
            items = "".join(self.leaf("li", t, True) for t in texts + [self.some(phrases) for _ in range(self.rng.randrange(5))])
            inner = self.some([f"<ul>{items}</ul>", f"<ol>{items}</ol>", " | ".join(f'<a href="/z">{escape(t)}</a>' for t in texts)])
        elif kind == "form":
            inner = "".join(self.leaf(self.some(["label", "p", "button", "div", "h3", "legend"]), t) + '<input name="q">' for t in texts)
        elif kind == "comments":
            one = self.some(["div", "li", "p", "article", "blockquote"])
            inside = self.some(["", ' class="comment"', ' class="reply"'])
            inner = self.leaf(self.some(["h3", "h2", "h4"]), self.some(phrases)) + "".join(
                f"<{one}{inside}>" + (escape(t, quote=False) if one == "p" else self.leaf("p", t)) + f"</{one}>" for t in texts)
        elif len(texts) == 1 and self.chance(0.5):
            inner = escape(texts[0], quote=False)
        else:
            inner = "".join(self.leaf(self.some(["p", "p", "div", "li", "h4", "h3", "span"]), t, kind == "sidebar" and self.chance(0.6))
                            for t in texts)
        return f"<{wrapper}{mark}>{inner}</{wrapper}>"

    def article(self) -> list[tuple[str, int]]:
        """Parts of an article with their labels; a part is whole markup."""
        parts, texts = [], list(self.some(self.articles)[:MOST_PARAGRAPHS])
        if self.chance(0.5):
            texts = texts[:1] + [self.prose() for _ in range(self.rng.randrange(1, 6))]
        title = self.leaf(self.some(["h1", "h1", "h2"]), texts[0])
        parts.append((f"<header>{title}</header>" if self.chance(0.2) else title, MAIN))
        kind = self.some(["p", "p", "p", "p", "div"])
        open_paragraphs = kind == "p" and self.chance(0.25)
        for text in texts[1:]:
            if self.chance(0.1):
                parts.append((self.leaf(self.some(["h2", "h3"]), " ".join(text.split()[:self.rng.randrange(1, 8)])), MAIN))
            if self.chance(0.06):
                words = self.prose().split()
                lists = "".join(self.leaf("li", " ".join(words[i:i + 4])) for i in range(0, len(words), 4))
                parts.append((self.some([f"<ul>{lists}</ul>", f"<ol>{lists}</ol>"]), MAIN))
            if self.chance(0.05):
                parts.append((f"<blockquote>{self.leaf('p', self.prose())}</blockquote>", MAIN))
            if self.chance(0.04):
                cells = "".join(f"<tr>{self.leaf('th', self.some(self.sentences)[:12])}{self.leaf('td', str(self.rng.randrange(999)))}</tr>" for _ in range(3))
                parts.append((f"<table>{cells}</table>", MAIN))
            if self.chance(0.04):
                parts.append((self.leaf("pre", self.prose()), MAIN))
            if self.chance(0.04):
                parts.append((f'<figure><img src="a.png">{self.leaf("figcaption", self.prose())}</figure>', MAIN))
            short = " ".join(text.split()[:self.rng.randrange(1, 5)]) if self.chance(0.2) else text
            parts.append((f"<p>{escape(short, quote=False)}" if open_paragraphs else self.leaf(kind, short), MAIN))
            if self.chance(0.06):
                parts.append((self.surrounding(self.some(["advert", "sidebar", "share", "form", "notice"])), OTHER))
        if self.chance(0.3):
            parts.append((self.surrounding(self.some(["share", "comments", "comments", "sidebar", "form", "footer"])), OTHER))
        return parts

    def page(self) -> tuple[str, list[int]]:
        """Markup and the labels of its blocks."""
        before = [self.surrounding(k) for k in ("notice", "header", "menu", "advert", "sidebar", "menu") if self.chance(0.5)]
        after = [self.surrounding(k) for k in ("share", "comments", "form", "sidebar", "advert", "notice", "footer") if self.chance(0.45)]
        if self.chance(0.6):
            after.append(self.surrounding("footer"))
        name = self.some(ARTICLE_NAMES)
        start, finish = self.some([
            ("<article>", "</article>"), ("<article>", "</article>"), (f'<article class="{name}">', "</article>"), ("<main>", "</main>"),
            ("<main><article>", "</article></main>"), (f'<div class="{name}">', "</div>"), (f'<div id="{name}">', "</div>"),
            (f'<div id="page"><div class="{name}">', "</div></div>"), (f'<section class="{name}">', "</section>"),
            (f'<div role="main" class="{name}">', "</div>"), ("<main><div>", "</div></main>"),
            (f'<table><tr><td class="{name}">', "</td></tr></table>")])
        pieces = [(p, OTHER) for p in before] + self.article() + [(p, OTHER) for p in after]
        first = len(before)
        last = len(pieces) - len(after)
        html, labels = "<!DOCTYPE html><html><head><title>x</title></head><body>", []
        for i, (piece, label) in enumerate(pieces):
            html += (start if i == first else "") + piece
            labels += [label] * len(blocks(piece))
            html += finish if i == last - 1 else ""
        return html + "</body></html>", labels


def labelled_pages(samples: list[str], layouts_per_page: int, least_layouts: int, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of the sampled pages that label themselves and of layouts made from them."""
    pages, articles, others = [], [], []
    for html in samples:
        found = blocks(html)
        short = len(found) <= MOST_BLOCKS and sum(len(b.text) for b in found) <= MOST_CHARS
        labels = own_labels(found) if short else None
        if labels:
            pages.append((found, labels))
            articles.append([b.text for b, y in zip(found, labels) if y == MAIN])
            others += [b.text for b, y in zip(found, labels) if y == OTHER]
    layouts = Layouts(seed, articles, others)
    for _ in range(max(least_layouts, layouts_per_page * len(pages))):
        html, labels = layouts.page()
        found = blocks(html)
        if len(found) == len(labels):  # markup whose parts run together is no good example
            pages.append((found, labels))
    return pages
