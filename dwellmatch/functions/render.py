"""Notification payload text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellmatch.functions.numbers import js_num
from dwellmatch.functions.urls import is_http_url

# Message and button texts.
HEADLINE = "🏠 <b>Новая квартира найдена</b>"
LINK_TEXT = "Ссылка на объявление"
NO_LINK = "🔗 Ссылка на объявление недоступна"
BUTTON_TEXT = "🔗 Открыть и написать"
MISSING = "—"


def escape_html(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def shown(c: Column, fallback: str = MISSING) -> Column:
    return F.coalesce(F.nullif(escape_html(c), F.lit("")), F.lit(fallback))


def http_or_null(c: Column) -> Column:
    return F.when(is_http_url(c), c)


def caption(url: Column, city: Column, price: Column, area: Column, rooms: Column, source: Column) -> Column:
    link = F.when(
        is_http_url(url), F.concat(F.lit('🔗 <a href="'), escape_html(url), F.lit(f'">{LINK_TEXT}</a>'))
    ).otherwise(NO_LINK)
    return F.concat_ws(
        "\n",
        F.lit(HEADLINE),
        F.lit(""),
        F.concat(F.lit("📍 "), shown(city, "")),
        F.concat(F.lit("💰 "), shown(js_num(price)), F.lit(" €")),
        F.concat(F.lit("📐 "), shown(js_num(area)), F.lit(" м²")),
        F.concat(F.lit("🛏 "), shown(js_num(rooms)), F.lit(" комнаты")),
        F.lit(""),
        link,
        F.lit(""),
        F.concat(F.lit("Источник: "), shown(source, "")),
    )


def first_photo(images: Column) -> Column:
    """First image with an http(s) address."""
    return F.get(F.filter(F.transform(images, lambda i: i["url"]), is_http_url), F.lit(0))


def payload(url: Column, city: Column, price: Column, area: Column, rooms: Column, source: Column, images: Column) -> Column:
    photo = first_photo(images)
    return F.struct(
        F.when(photo.isNotNull(), "photo").otherwise("text").alias("kind"),
        caption(url, city, price, area, rooms, source).alias("caption"),
        photo.alias("photo"),
        http_or_null(url).alias("button_url"),
    )
