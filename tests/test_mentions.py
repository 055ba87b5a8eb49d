from foliospark.operators import prep, terms


def rows(df):
    return sorted((r["doc_id"], r["norm"], tuple(r["sent_id"]), r["sentence"], r["start"], r["surface"]) for r in df.collect())


def test_few_and_many_terms_are_found_alike(spark, monkeypatch):
    texts = ["Digital Literacy Skills grow. We saw Digital Literacy Skill, and \"digital-literacy skills\" too. Digital. Literacy Skill.", "Job Satisfaction Level predicts Digital Literacy Skill: Job Satisfaction Levels fell (job satisfaction, level).", "Éco Théories and Éco Théorie; éco, théories! A Study Policies Rule. Study Policy Rules.", "", None]
    p = spark.createDataFrame([(d, k, t) for d in (1, 2) for k, t in enumerate(texts)], "doc_id long, para_no long, text string")
    few, edges = rows(terms.mentions(p)), {tuple(r) for r in terms.paragraph_relations(p).collect()}
    assert edges == {tuple(r) for r in terms.relations(terms.mentions(p)).collect()}
    assert (1, "PREDICTS", "job satisfaction level", "digital literacy skill", False) in edges
    monkeypatch.setattr(terms, "FEW_TERMS", 0)
    assert rows(terms.mentions(p)) == few and {tuple(r) for r in terms.paragraph_relations(p).collect()} == edges
    assert {r[1] for r in few} >= {"digital literacy skill", "job satisfaction level"}


def test_sentences_of_one_word_and_more(spark):
    df = spark.createDataFrame([("One.  Two\u00a0words. Now three\twords.\n\nSee e.g. \u200b this.",)], "t string").select(prep.sentence_array("t", 1).alias("a"), prep.sentence_array("t", 3).alias("b"))
    a, b = df.first()
    assert a == ["One.", "Two words.", "Now three words.", "See e.g. this."] and b == a[2:]
