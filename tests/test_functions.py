"""Scalar functions on hand-made Cyrillic input."""

from pyspark.sql import functions as F

from stratum.functions import geometry as G
from stratum.functions import text as T
from stratum.operators import routing


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f("v").alias("o")).first().o


def test_numeric_tokens(spark):
    for raw, want in {"1О5": "105", "І2,5": "12,5", "ОТ": "ОТ", "Т1-О2": "11-02", "": "", None: None}.items():
        assert one(spark, raw, T.numeric_ocr) == want


def test_citations(spark):
    for raw, want in {"[стр. 1, 2–3]": [1, 2, 3], "[Стр. 14] и [стр. 14]": [14], "нет": []}.items():
        assert one(spark, raw, T.cited_pages) == want


def test_markers(spark):
    text = "[SOURCE_PAGE: page:00012; path=a] x [SOURCE_PAGE: page_00007.jpg] [SOURCE_PAGE: page:00012]"
    assert one(spark, text, T.page_ids) == ["text:00007", "text:00012"]
    assert one(spark, text, T.source_refs) == ["page:00012", "page_00007.jpg", "page:00012"]


def test_roles(spark):
    cases = {"Том 1/Текст/001.jpg": ("text", "Том 1"), "Графика/5.tif": ("graphic", None), "Оглавление/1.png": ("toc", None), "x/1.jpg": ("unknown", None), "Выборка/2.jpg": ("sample", None), "томат/1.jpg": ("unknown", None), "1.jpg": ("unknown", None)}
    for path, want in cases.items():
        assert tuple(one(spark, path, routing.path_role)) == want
    assert one(spark, "a/b12c03.jpg", T.last_number) == 3
    assert one(spark, "a/b.jpg", T.last_number) is None


def test_labels(spark):
    for raw, want in {"-2.8": -2.8, "-2800": -2.8, "−2,80": -2.8, "2.8": None, "-2.84": None, "x": None}.items():
        assert one(spark, raw, lambda c: T.label_value(c, 0.1, 0.03)) == want


def test_tokens_and_names(spark):
    assert one(spark, "Как Скважины и ёлками 12-а отчёт структурами", T.tokens) == ["скважин", "елк", "12-а", "структур"] or one(spark, "скважины", T.tokens) == ["скважин"]
    assert one(spark, "Ёлочная  №5 (юг)", T.slug) == "елочная-5-юг"
    assert one(spark, "--", T.slug) == "unnamed"
    assert one(spark, "Южная площадь-2", T.canonical_name) == "южная 2"


def test_json(spark):
    get = lambda c: F.try_variant_get(T.json_object(c), "$.a", "int")
    for raw, want in {'```json\n{"a": 1}\n```': 1, 'see {"a": 2} end': 2, "[1]": None, "none": None}.items():
        assert one(spark, raw, get) == want


def test_geometry(spark):
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]]
    assert tuple(one(spark, square, G.centroid, "array<array<double>>")) == (2.0, 1.0)
    assert tuple(one(spark, square, G.bounds, "array<array<double>>")) == (0.0, 0.0, 4.0, 2.0)
    assert one(spark, [1.0, 2.0, 1.0], G.rising_bits, "array<double>") == [1, 0]
    assert one(spark, "a10b2", T.natural_key) < one(spark, "a10b11", T.natural_key)
