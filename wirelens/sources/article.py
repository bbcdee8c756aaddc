"""Article pages: text by extractor specs, the main picture, service paragraphs."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelens.functions.text import fold, squeeze
from wirelens.sources.dom import Node, ended_references, of_pages, parsed

#: How service paragraphs begin.
SERVICE = ("фото:", "видео:", "ранее сообщалось", "ранее стало известно", "напомним", "читайте также", "реклама")


@dataclass(frozen=True)
class Extractor:
    """Where a site keeps an article: its container (a selector), what must be around it, what is dropped from it, and
    which elements are paragraphs. Without the container the text is empty, never the page's surroundings."""

    container: str
    around: str | None = None  # an ancestor that must be there
    headline: str | None = None  # what that ancestor must hold
    inner: str | None = None  # a part of the container that alone counts
    drop: tuple[str, ...] = ()
    blocks: tuple[str, ...] = ("p",)
    direct: bool = False  # only direct children
    within: str | None = None  # an ancestor that each paragraph must have
    stop: str | None = None  # a paragraph that begins so ends the article
    leave_out: tuple[str, ...] = ()  # paragraphs, folded, that are none
    ended: bool = False  # character references count only with their semicolon


#: Specs by the name of a source's platform.
EXTRACTORS: dict[str, Extractor] = {
    "vn": Extractor('#newstext.one-news-text[itemprop="articleBody"]', "article", "h1.det_news_title", drop=("aside.divider", ".news-block-cit", ".related-news", ".recommendation"), blocks=("div", "p"), direct=True),
    "e1": Extractor("article", headline="h1"),
    "platform": Extractor('div[class^="articleContent_"]', "article", "h1", drop=("figure",), within='div[class^="uiArticleBlockText_"]'),
    "media": Extractor('.page-content.io-article-body[itemprop="articleBody"]', "div.page-fullnews", "h1", drop=(".noprint", ".news_links_related", ".page-content__related")),
    "agn": Extractor('div.text[itemprop="articleBody"]', "div#Article", 'h1.title[itemprop="headline"]', direct=True),
    "amic": Extractor("section.text", "div#post", "h1", blocks=("p", "blockquote"), direct=True),
    "a42": Extractor('.material__body[itemprop="articleBody"]', "article.material", "h1", inner=".rte-block.rte-text"),
    "mk": Extractor('.article__body[itemprop="articleBody"]', direct=True, stop="читайте также"),
    "bnk": Extractor(".b-news-single .cnt.daGallery", drop=("script", "style", "figure", ".pic-container", ".item__image", ".telegram", ".max", ".ya-share2", ".tags", ".cookie-banner")),
    "komi": Extractor('.news-view [itemprop="articleBody"]', drop=("script", "style", "figure", ".pic-container", ".item__image", ".telegram", ".max", ".ya-share2", ".tags", ".cookie-banner")),
    "nao": Extractor("article.fullstory .box_in .text", drop=("script", "style", "figure", ".pic-container", ".item__image", ".telegram", ".max", ".ya-share2", ".tags", ".cookie-banner")),
    "severpost": Extractor(".c-post-block > h1 ~ hr ~ div", drop=("script", "style", "figure", ".pic-container", ".item__image", ".telegram", ".max", ".ya-share2", ".tags", ".cookie-banner")),
    "regional": Extractor('div[class^="articleContent_"]', "article", "h1", drop=("figure",), within='div[class^="uiArticleBlockText_"]', leave_out=("знаете что-то об этом дтп? расскажите нам!", "вам известны детали произошедшего? расскажите нам.", "вам есть что рассказать по этой теме? напишите нам.")),
}


def register_extractor(name: str, spec: Extractor) -> None:
    EXTRACTORS[name] = spec


def extract(html: str, spec: Extractor | None) -> str:
    """Paragraphs joined by a blank line: of the whole page without a spec."""
    with parsed(ended_references(html or "") if spec and spec.ended else html or "") as page:
        return _extract(page, spec)


def _extract(page: Node, spec: Extractor | None) -> str:
    if spec is None:
        return "\n\n".join(t for p in page.find_all(("p",)) if (t := p.text()))
    body = page.select(spec.container)
    if body is None:
        return ""
    if spec.around or spec.headline:
        around = body if spec.around is None else body.ancestor(spec.around)
        if around is None or (spec.headline and around.select(spec.headline) is None):
            return ""
    if spec.inner and (body := body.select(spec.inner)) is None:
        return ""
    for selector in spec.drop:
        for node in body.select_all(selector):
            node.remove()
    out = []
    for block in body.find_all(spec.blocks, direct=spec.direct):
        if spec.within and block.ancestor(spec.within) is None:
            continue
        text = block.text()
        if spec.stop and text.casefold().startswith(spec.stop):
            break
        if text and text.casefold() not in spec.leave_out and not (spec.leave_out and "новостей и даже без интернета" in text.casefold() and "нашем канале в max" in text.casefold()):
            out.append(text)
    return "\n\n".join(out)


def article_text(html: Column, extractor: Column) -> Column:
    """The article's text by the named extractor; all paragraphs for a name that isn't known."""
    specs = dict(EXTRACTORS)

    def convert(pages: pa.Array, names: pa.Array) -> pa.Array:
        return of_pages(lambda h, n: extract(h, specs.get(n)), pa.string(), pages, names)

    return F.arrow_udf(convert, "string")(html, extractor)


def image_of(html: str, url: str) -> str | None:
    """The page's main picture: og:image, or twitter:image where that tag is absent; absolute."""
    with parsed(html or "") as page:
        meta = page.select('meta[property="og:image"]') or page.select('meta[name="twitter:image"]')
        value = (meta.attributes.get("content") or "").strip() if meta else ""
    return urljoin(url or "", value) if value else None


def image_url(html: Column, url: Column) -> Column:
    def convert(pages: pa.Array, urls: pa.Array) -> pa.Array:
        return of_pages(image_of, pa.string(), pages, urls)

    return F.arrow_udf(convert, "string")(html, url)


def clean_paragraphs(text: Column, stops: tuple[str, ...] = (), service: tuple[str, ...] = SERVICE) -> Column:
    """Paragraphs (between blank lines) before the first that begins like a footer, without service ones."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), squeeze), lambda p: p != "")
    begins = lambda p, marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.startswith(fold(p), m)) if marks else F.lit(False)
    end = F.array_position(F.transform(parts, lambda p: begins(p, stops)), True)
    kept = F.when(end > 0, F.slice(parts, F.lit(1), (end - 1).cast("int"))).otherwise(parts)
    return F.array_join(F.filter(kept, lambda p: ~begins(p, service)), "\n\n")
