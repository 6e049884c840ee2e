from strandwise.llm import language


def test_copies_do_not_take_the_place_of_other_texts(spark, monkeypatch):
    thai = [f"นักเรียนได้เรียนรู้การคิดเชิงวิพากษ์ในห้องเรียนชนบท ตอนที่ {i} ของโครงการ" for i in range(30)]
    english = [f"The pupils of school number {i} have learned to question what they read." for i in range(30)]
    rows = [(t, "th") for t in thai] + [(thai[0], "th")] * 6000 + [(t, "en") for t in english]
    seen = {}
    fit = language.fit_model
    monkeypatch.setattr(language, "fit_model", lambda texts, labels: seen.update(texts=texts) or fit(texts, labels))
    model = language.fit_from(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 40)
    assert model.languages == ["en", "th"] and sorted(seen["texts"]) == sorted(thai + english)
