"""TTML with cues worked out by hand."""

from reelframe.sources import ttml


def docs(spark, *texts, doc=1):
    return spark.createDataFrame([(doc, k, t) for k, t in enumerate(texts)], "doc_id long, seg_pos long, text string")


def cues(spark, *texts, **more):
    found, errors = ttml.ttml_cues(docs(spark, *texts), **more)
    return [tuple(r)[2:] for r in found.orderBy("cue_pos").collect()], [(r["seg_pos"], r["error"]) for r in errors.orderBy("seg_pos").collect()]


def tt(body, head=""):
    return f'<tt xmlns="http://www.w3.org/ns/ttml" xmlns:tts="urn:tts" xmlns:smpte="urn:smpte">{head}<body><div>{body}</div></body></tt>'


def test_texts_images_and_order(spark):
    head = '<head><smpte:image xml:id="img"> AAAA </smpte:image></head>'
    text = tt('<p begin="1s" end="2.5s"><span tts:fontStyle="italic">Hello</span>\n World </p><p begin="00:00:03.000" end="00:00:04.000" smpte:backgroundImage="#img"/><p begin="5s" end="6s">a<!-- x -->b<span>c<br/> d <i>e</i></span>f</p>', head)
    assert cues(spark, text) == ([(1000, 2500, "<i>Hello</i>\r\nWorld"), (3000, 4000, "Base64::AAAA"), (5000, 6000, "a\r\nb\r\nc\r\nde\r\nf")], [])
    made = ttml.images(ttml.ttml_cues(docs(spark, text))[0]).orderBy("cue_pos").collect()
    assert [(r["payload"], r["image"] and bytes(r["image"])) for r in made][1] == ("0.png", bytes(3)) and made[0]["image"] is None


def test_joins_repeats_and_groups(spark):
    p = lambda a, b, t, r="": f'<p begin="{a}s" end="{b}s" region="{r}">{t}</p>'
    first = tt(p(1, 2, "x") + p(2, 3, "x") + p(3, 4, "x", "up") + p(3, 4, "y") + p(1, 3, "x") + p(3, 4, "  "))
    assert cues(spark, first) == ([(1000, 3000, "x"), (3000, 4000, "x\r\ny")], [])
    # what is there already is left out, and then the last one goes on
    assert cues(spark, first, tt(p(3, 4, "y") + p(4, 5, "y"))) == ([(1000, 3000, "x"), (3000, 4000, "x"), (3000, 5000, "y")], [])
    assert cues(spark, tt(p(1, 2, "x") + p(3, 4, "y")), base_ms=2000)[0] == [(1000, 2000, "x"), (3000, 4000, "y")]
    assert cues(spark, tt(p(2, 3, "x")), base_ms=2000)[0] == [(0, 1000, "x")]


def test_shifts_untimed_repairs_and_errors(spark):
    timed = tt('<p begin="00:00:01.000" end="00:00:02.000">a</p>')
    assert cues(spark, timed, timed, segment_ms=1500)[0] == [(1000, 2000, "a"), (2500, 3500, "a")]
    assert cues(spark, tt('<p begin="" end="2s">a</p><p end="2s">b</p><p>c</p>')) == ([], [])
    # divisions count where there are no paragraphs
    assert cues(spark, '<tt><body><div begin="1s" end="2s">d</div></body></tt>')[0] == [(1000, 2000, "d")]
    odd = tt('<p begin="1s" end="2s">Hi <font ab:cd="1"> & you</p>')
    assert cues(spark, odd) == ([(1000, 2000, 'Hi <font ab:cd="1"> & you')], [])
    assert cues(spark, "<tt><p>", None, "", "no document", tt('<p begin="x" end="2s">a</p><p begin="1s" end="2s">b</p>')) == ([(1000, 2000, "b")], [(0, "no XML"), (4, "times")])
    assert ttml.ttml_cues(docs(spark, timed).where("false"))[0].count() == 0


def test_documents_in_segments(spark):
    box = lambda n, x: (len(x) + 8).to_bytes(4, "big") + n + x
    one = "<tt><p begin='1s' end='2s'>Caption</p></tt>".encode()
    rows = [(1, 0, bytearray(box(b"moof", b"") + box(b"mdat", b"\xff\x00" + one + b"junk" + one.replace(b"Caption", b"Two")))), (1, 1, bytearray(box(b"mdat", one)[:-1])), (1, 2, None)]
    found = ttml.documents_in(spark.createDataFrame(rows, "doc_id long, seg_pos long, data binary"))
    assert found.count() == 2
    got = ttml.ttml_cues(found)[0].collect()
    assert [tuple(r)[2:] for r in got] == [(1000, 2000, "Caption\r\nTwo")]


def test_one_exchange_and_one_reading(spark):
    p = lambda a, b, t: f'<p begin="{a}" end="{b}">{t}</p>'
    texts = [tt(p("1s", "2s", "a") + p("x", "2s", "no") + p("1s", "2s", "b") + p("100:00:00.000", "100:00:01.5", "c")), "<tt><p>", tt(p("x", "y", "z"))]
    found, errors = ttml.ttml_cues(docs(spark, *texts))
    assert [tuple(r) for r in found.orderBy("cue_pos").collect()] == [(1, 0, 1000, 2000, "a\r\nb"), (1, 1, 360_000_000, 360_001_500, "c")]
    assert [tuple(r) for r in errors.orderBy("seg_pos").collect()] == [(1, 0, 0, "times"), (1, 1, 0, "no XML"), (1, 2, 0, "times")]
    plan, wrong = (x._jdf.queryExecution().sparkPlan().toString() for x in (found, errors))
    assert (plan.count("Exchange"), plan.count("Window"), plan.count("Aggregate"), wrong.count("MapInArrow"), wrong.count("Union")) == (1, 0, 0, 1, 0)
    assert ttml.documents_in(spark.createDataFrame([(1, 0, None)], "doc_id long, seg_pos long, data binary")).count() == 0
