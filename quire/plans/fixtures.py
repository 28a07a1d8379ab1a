"""Small inputs of our own for operators that the driver tables have no rows for: pages, graphs, catalogues, manifests, reports."""

PAGE = """<?xml version="1.0"?><PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageFilename="p.jpg" imageWidth="100" imageHeight="80">
<ReadingOrder><OrderedGroup id="g"><RegionRefIndexed index="1" regionRef="b"/><OrderedGroupIndexed index="0" id="h"><RegionRefIndexed index="0" regionRef="c"/></OrderedGroupIndexed></OrderedGroup></ReadingOrder>
<TextRegion id="a"><Coords points="1,2 30,4 5,60"/><TextLine id="a1"><TextEquiv><Unicode>late</Unicode></TextEquiv></TextLine></TextRegion>
<TextRegion id="b"><Coords points="0,0 9,9"/><TextLine id="b1"><TextEquiv><Unicode>ﬁrst line</Unicode></TextEquiv><TextEquiv><Unicode>other</Unicode></TextEquiv></TextLine><TextLine id="b2"><TextEquiv><Unicode>second</Unicode></TextEquiv></TextLine>
<TextEquiv><Unicode>x</Unicode></TextEquiv><TextEquiv><Unicode>a region text of some length</Unicode></TextEquiv></TextRegion>
<TextRegion id="c"><Coords points="7,7"/><TextLine id="c1"><TextEquiv><Unicode>top</Unicode></TextEquiv></TextLine></TextRegion>
<TextRegion id="d"><Coords points="1,1"/><TextLine id="d1"/></TextRegion></Page></PcGts>"""
PAGES = [("/in/abc/1905/p1.xml", PAGE), ("/in/abc/1905/p2.xml", "<PcGts><Page>"), ("/in/xyz/1906/p3.xml", PAGE.split("<ReadingOrder>")[0] + PAGE.split("</ReadingOrder>")[1])]
REGION_ROWS = [
    ("/in/abc/1905/p1.xml", "c", 0, "top"), ("/in/abc/1905/p1.xml", "b", 1, "ﬁrst line\nsecond"), ("/in/abc/1905/p1.xml", "a", 2, "late"), ("/in/abc/1905/p2.xml", None, None, None),
    ("/in/xyz/1906/p3.xml", "a", 0, "late"), ("/in/xyz/1906/p3.xml", "b", 1, "ﬁrst line\nsecond"), ("/in/xyz/1906/p3.xml", "c", 2, "top"),
]

_HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:bk="https://gams.uni-graz.at/o:depcha.bookkeeping#" xmlns:arec="https://gams.uni-graz.at/o:arec.ontology#">'


def _entry(root: str, unit: str, extra: str = "") -> str:
    return (
        f'<bk:Transaction rdf:about="urn:t#{root}"><bk:entry>paid  to\nhim</bk:entry><bk:consistsOf><bk:Transfer rdf:about="urn:t#{root}T1"><bk:from rdf:resource="urn:t#anna"/>'
        f'<bk:transfers><bk:Money rdf:about="urn:t#{root}T1M1"><bk:unit>{unit}</bk:unit><bk:quantity>5</bk:quantity></bk:Money></bk:transfers>{extra}</bk:Transfer></bk:consistsOf></bk:Transaction>'
    )


GRAPHS = [
    ("truth", _HEAD + _entry("T1", "lb") + _entry("T2", "s") + '<arec:Note rdf:about="urn:t#N1"><bk:entry>n</bk:entry></arec:Note></rdf:RDF>'),
    ("test", _HEAD + _entry("T1", "lb") + _entry("T9", "d", '<bk:when>1455</bk:when>') + "</rdf:RDF>"),
    ("broken", "<rdf:RDF>"),
]
#: kind, place, common, missing, extra.
GRAPH_SCORES = [
    ("exact", 0, 6, 0, 0), ("exact", 1, 5, 1, 2), ("identifier", 0, 6, 0, 0), ("identifier", 1, 5, 1, 2), ("structural", 0, 6, 0, 0), ("structural", 1, 6, 0, 1),
]

PERSONS_SCHEMA_ROWS = [
    ("p1", "Müller (Hans) / Molitor", "Hans Müller, Kg", "Hans", ["Muller"], [], (["Hanns Mueller"], "1450", "1460", ["d1", "d2"], ["Wien"], [("d1", "1451", "Hans sold a house")])),
    ("p2", "Schmidt-Lang", "Peter Schmidt-Lang", None, [], ["Faber"], ([], "1440", "1441", ["d3"], [], [])),
    ("p3", "Papst Pius", "Papst Pius", None, [], [], (["Eneas"], "1458", "1464", [], ["Rom"], [])),
]
DIGEST_ROWS = [
    ("d1", "1455", "Wien", "text", [("Hans Muler", "direct"), ("der Papst", "indirect"), ("Nobody", "direct")],
     [("p1", "known", 12, False, ("Hans Muler", "direct")), ("p3", "known", 0, False, ("der Papst", "indirect")), ("n1", "new", 0, False, ("Nobody", "direct")), ("p2", "known", 3, True, None)]),
]

MANIFESTS = [
    ("m3", '{"metadata":[{"label":{"de":["Jahr"]},"value":{"de":["ca. 1905"]}}],"items":[{"items":[{"items":[{"motivation":"painting","body":{"id":"http://x/a.jpg","service":[{"id":"http://x/s/1"}]}},{"motivation":"other","body":{"id":"no"}}]}]},{"items":[{"items":[{"motivation":"painting","body":{"id":"http://x/b.jpg"}}]}]}]}'),
    ("m2", '{"sequences":[{"canvases":[{"images":[{"resource":{"service":{"@id":"http://y/1/"}}}]},{"images":[{"resource":{"service":{"@id":"http://y/2"}}}]}]}]}'),
    ("m0", '{"other":1}'),
]
MANIFEST_PAGES = [
    ("m3", 3, "ok", "1905", 0, "http://x/s/1/full/max/0/default.jpg"), ("m3", 3, "ok", "1905", 1, "http://x/b.jpg"), ("m2", 2, "ok", None, 0, "http://y/1/full/max/0/default.jpg"),
    ("m2", 2, "ok", None, 1, "http://y/2/full/max/0/default.jpg"), ("m0", None, "unknown structure", None, None, None),
]

REPORTS = [
    ("/r/L343_glm-5.html", "<h2>Structure</h2><table><tr><th>Macro</th><td>0.9</td><td>0.8</td><td>0.85</td></tr><tr><td>Micro</td><td>0.7</td><td> 0.6</td><td><b>0.65</b></td></tr></table><h2>Content</h2><tr><td>macro</td><td>1</td><td>0.5</td><td>0.667</td></tr>"),
    ("/r/readme.html", "<h2>Structure</h2><tr><td>macro</td><td>1</td></tr>"),
]
REPORT_SCORES = [
    ("L343", "glm-5", "Structure", "macro", "precision", 0.9), ("L343", "glm-5", "Structure", "macro", "recall", 0.8), ("L343", "glm-5", "Structure", "macro", "f1", 0.85),
    ("L343", "glm-5", "Structure", "micro", "precision", 0.7), ("L343", "glm-5", "Structure", "micro", "recall", 0.6), ("L343", "glm-5", "Structure", "micro", "f1", 0.65),
    ("L343", "glm-5", "Content", "macro", "precision", 1.0), ("L343", "glm-5", "Content", "macro", "recall", 0.5), ("L343", "glm-5", "Content", "macro", "f1", 0.667),
]
