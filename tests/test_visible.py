from pagewright.functions.visible import terms, text_terms, visible_lines, visible_text


def test_visible_text():
    assert visible_text("<p>a<!-- x\ny --><b>b</b></p><script>c</script>&amp; &#233;") .split() == ["a", "b", "&", "é"]
    assert visible_lines("<p>a</p>\n<style>x</style>\n\nb &lt;i&gt;") == [" a ", "", "", "b <i>"]
    assert visible_text(None) == "" and visible_text("") == "" and visible_lines("1 < 2") == ["1 < 2"]


def test_terms_are_casefolded():
    assert terms("Straße_x ΣΑΣ ﬁn İa") == ["strasse", "x", "σασ", "fin", "i̇a"]
    assert text_terms("") == []
