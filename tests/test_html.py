from lutrin.functions.html import extract
from lutrin.sources.files import articles_of

PAGE = """<html><head><title>3/02/2031&nbsp;&gt; BE France&nbsp;777&nbsp;&gt; Un titre</title></head><body>
<p><span class="style32">BE France 777</span><span class="style42">&nbsp;&nbsp;14/09/2030</span></p>
<p class="style96"><span class="style42">Focus<br></span><span class="style17"> Un titre </span></p>
<p><span class="style88">http://www.example.org/actualites/123456.htm</span></p>
<p class="style96"><span class="style95">Un pont &agrave; haubans.<br /><br />Cette <b>partie</b> reste.</span>
<div align="center"><a href="x"><img src="a.jpg" style="margin-bottom:5px"></a><br /><span class="style21">L&eacute;gende</span></div></p>
<table><tr><td><table><tr><td><p><span class="style28">Pour en savoir plus, contacts :</span></p></td><td><p><span class="style85">Labo - t&eacute;l. : 1</span></p></td></tr>
<tr><td><p><span class="style28">R&eacute;dacteur :</span></p></td><td><p><span class="style95">AVT - Jean-Luc Petit - email : <a href="m">x@y</a></span></p></td></tr></table></td></tr></table>
<p><span class="style15">BE France num&eacute;ro 777 (3/02/2031) - http://www.example.org/actualites/123456.htm</span></p></body></html>"""


def test_all_fields():
    r = extract(PAGE)
    assert r["bulletin"] == "777" and r["article"] == "123456" and r["date"] == "3/02/2031"
    assert r["rubrique"] == "Focus" and r["titre"] == "Un titre"
    assert r["texte"] == "Un pont à haubans.Cette  reste."
    assert r["auteur"] == "Jean-Luc Petit"
    assert r["contact"] == "Labo - tél. : 1"
    assert r["images"] == [{"url": "a.jpg", "legend": "Légende"}]
    assert extract(PAGE, strict_images=True)["images"] == []


def test_author_needs_email():
    assert extract(PAGE.replace("email", "Emai"))["auteur"] == ""


def test_nothing_found():
    r = extract("<p>rien")
    assert r["article"] is None and r["images"] == []
    assert all(r[k] == "" for k in ("bulletin", "date", "rubrique", "titre", "auteur", "texte", "contact"))
    assert extract(None) is None
    assert extract("")["titre"] == ""


def test_block_ends_paragraph():
    page = '<p class="style96"><span class="style95">un</span><div>x</div><span class="style95">deux</span></p>'
    assert extract(page)["texte"] == "un"


def test_frame_of_pages(spark):
    rows = articles_of(spark.createDataFrame([("a", PAGE), ("b", None), ("c", "")], "path string, html string")).orderBy("path").collect()
    assert [r.bulletin for r in rows] == ["777", None, ""]
    assert rows[0].images[0].legend == "Légende"


def test_variants(spark):
    from lutrin.sources.files import image_lists

    assert extract(PAGE, two_digit_days=True)["date"] == ""
    assert extract(PAGE, article_from="style15")["article"] == "123456" and extract("", article_from="style15")["article"] == ""
    assert extract(PAGE, first_title_node=True)["titre"] == " Un titre " and extract("", first_title_node=True)["titre"] is None
    df = articles_of(spark.createDataFrame([("a", PAGE)], "path string, html string"), article_from="style15")
    row = image_lists(df).first()
    assert row.images_url == ["a.jpg"] and row.images_legend == ["Légende"] and row.article == "123456"


def cell(label, text):
    return f'<tr><td><span class="style28">{label}</span></td><td>{text}</td></tr>'


def test_author_is_the_first_that_matches():
    page = "<table>" + cell("R&eacute;dacteur :", "sans nom") + cell("R&eacute;dacteur :", "AVT - Jean Petit - email : x") + cell("R&eacute;dacteur :", "AVT - Autre - email : x") + "</table>"
    assert extract(page)["auteur"] == "Jean Petit"
    # A name doesn't go beyond its line.
    assert extract("<table>" + cell("R&eacute;dacteur", "AVT - Jean\nPetit - email") + "</table>")["auteur"] == ""


def test_rubrique_without_white_space_of_any_part():
    assert extract('<span class="style42">Focus <b>Energie</b> </span>')["rubrique"] == "FocusEnergie"


def test_first_own_text_of_all_spans():
    page = '<span class="style88"><b>x</b></span><span class="style88">http://a/77.htm</span><span class="style17"><i>y</i></span><span class="style17">Deux</span>'
    assert extract(page)["article"] == "77" and extract(page, first_title_node=True)["titre"] == "Deux" and extract(page)["titre"] == "y"


def test_deep_nesting():
    deep = "<i>" * 3000 + "fond" + "</i>" * 3000
    r = extract(f'<title>BE X 7</title><span class="style42">{deep}</span><table>' + cell("contact", deep) + "</table>" + "<table><tr><td>" * 300 + deep)
    assert r["rubrique"] == "fond" == r["contact"]


def test_nested_cells_share_a_label():
    inner = "<table>" + cell("Pour en savoir plus, contacts :", "dedans") + "</table>"
    assert extract(f"<table><tr><td>{inner}</td><td>dehors</td></tr></table>")["contact"] == "dedans"
