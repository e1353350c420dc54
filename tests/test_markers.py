import time

import pytest

from korpusflow.operators import segment
from korpusflow.operators.markers import markers_of, nested

HEADERS = [
    ("MADDE 1- (1) Amaç", [("article", "1"), ("paragraph", "1")]),
    ("madde 2 – Kapsam", [("article", "2")]),
    ("M ADDE 3 . - Nokta", [("article", "3")]),
    ("MADDE\n4 - Alt satır", [("article", "4")]),
    ("MADDE l5 - Okuma", [("article", "15")]),
    ("MADDE 1 2 - Bölünmüş", [("article", "12")]),
    ("MADDE 16 (Mülga: 1/1/2000-1/1 md.)", [("article", "16")]),
    ("MADDE 17/A - Harfli", [("article", "17/A")]),
    ("MADDE 18 – 7 yaşından küçükler", [("article", "18")]),
    ("MADDE 21 Metin devam eder", [("article", "21")]),
    ("MADDE 22", [("article", "22")]),
    ("MADDE 23, metin", []),
    ("Bu madde 24 - sayılmaz", []),
    ("Ek Madde - Sayısız", [("additional_article", None)]),
    ("GEÇİCİ MADDE – Sayısız", [("temporary_article", None)]),
    ("MADDE - Sayısız", []),
    ("EK GEÇİCİ MADDE 2 – Ek geçici", [("additional_temporary_article", "2")]),
    ("MÜKERRER MADDE 20 - Tekrar", [("repeated_article", "20")]),
    ("İKİNCİ KISIM", [("part", "İKİNCİ")]),
    ("IV BÖLÜM", [("chapter", "IV")]),
    ("İKİNCİ KISIM metni", []),
    ("EK-1", [("annex", "EK-1")]),
    ("(I) SAYILI CETVEL Tablo", [("annex", "(I) SAYILI CETVEL")]),
    ("12 SAYILI TARİFE", [("annex", "12 SAYILI TARİFE")]),
    ("Ek fıkra metni", []),
    ("(1) maddesiz", []),
]


@pytest.mark.parametrize("text, expected", HEADERS)
def test_headers(text, expected):
    assert [(m.unit_type, m.label) for m in markers_of(text)] == expected


@pytest.mark.parametrize("text, last, represented", [
    ("MADDE 6 İLA 8 - Değişik", 8, ["6", "7", "8"]), ("MADDE 6 İLA 8", 8, ["6", "7", "8"]), ("MADDE 9-11 - Aralık", 11, ["9", "10", "11"]),
    ("MADDE 13–14 (Mülga)", 14, ["13", "14"]), ("MADDE 3-4/A - Harfli son", 4, ["3", "4", "4/A"]), ("MADDE 8 İLA 6 - Ters", None, None),
    ("MADDE 5 - 7 kişi", None, None),
])
def test_ranges(text, last, represented):
    (marker,) = markers_of(text)
    assert (marker.last, marker.represented) == (last, represented)


@pytest.mark.parametrize("end", [
    "4857 SAYILI KANUNA İŞLENEMEYEN GEÇİCİ MADDELER", "Ek liste: 4857 sayılı Ana Kanuna işlenemeyen hükümler",
    "657 SAYILI KANUNA EK VE DEĞİŞİKLİK GETİREN MEVZUATIN LİSTESİ", "4857 SAYILI KANUNDA EK VE DEĞİŞİKLİK YAPAN MEVZUATIN YÜRÜRLÜĞE\nGİRİŞ TARİHLERİNİ GÖSTERİR LİSTE",
])
def test_nothing_counts_after_the_law(end):
    text = f"MADDE 1 - Bir.\n{end}\nMADDE 99 - Başka.\nEK-1"
    found = markers_of(text)
    assert [(m.unit_type, m.label) for m in found] == [("article", "1"), ("annex", "supplement")] and text[found[1].start :].startswith(end)
    assert len(markers_of(text.replace("SAYILI", "NO").replace("sayılı", "no"))) == 3


def test_state_headings_and_metadata():
    text = "Giriş\n\nBİRİNCİ KISIM\n\nGenel Hükümler\nAmaç\nMADDE 1-\n1) önce bent yok\na) bent\n1) alt\nii) alt iki\n(2) fıkra\nBİRİNCİ BÖLÜM\nMADDE 2 - x.\nb)bitişik\nKapsam:\nMADDE 3 - y"
    found = markers_of(text)
    assert [(m.unit_type, m.label, m.heading) for m in found] == [
        ("metadata", "document", None), ("part", "BİRİNCİ", "Genel Hükümler"), ("article", "1", "Amaç"), ("item", "a", None), ("subitem", "1", None), ("subitem", "ii", None),
        ("paragraph", "2", None), ("chapter", "BİRİNCİ", None), ("article", "2", None), ("article", "3", None),
    ]
    units = nested(found, len(text))
    assert [text[u.marker.start : u.end] for u in units][:2] == ["Giriş\n\n", text[7:]]
    assert units[4].path == ["part:BİRİNCİ", "article:1", "item:a", "subitem:1"] and units[9].path == ["part:BİRİNCİ", "chapter:BİRİNCİ", "article:3"]
    assert markers_of("") == [] and markers_of("düz metin\nsatır") == [] and nested([], 5) == []


def test_a_text_of_many_markers_takes_seconds(spark):
    n = 65_000
    text = "".join(f"MADDE {i} - Metin\n(1) Bir\na) iki\n" for i in range(n))
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "document_id string, text string")
    begun = time.time()
    found = segment.units(docs)
    assert found.count() == 3 * n and time.time() - begun < 60
    last = found.orderBy("unit_index", ascending=False).first()
    assert last.unit_path == [f"article:{n - 1}", "paragraph:1", "item:a"] and text[last.char_start : last.char_end] == last.text == "a) iki"
