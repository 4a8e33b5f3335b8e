from mendwell.operators import extraction as X


def articles(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "siis_id bigint, content string")


def test_sections_steps_and_groups(spark):
    a = articles(spark, "intro\n## Step 1: Check it\nPlease tap Wi-Fi and then open Settings. This is only talk.\nOpen Settings\nTap it.\n## Reset\nGo to Settings. Open Settings again")
    secs = X.sections(a)
    assert [(r.section_no, r.heading, len(r.body)) for r in secs.orderBy("section_no").collect()] == [(1, "Step 1: Check it", 3), (2, "Reset", 1)]
    steps = X.grouped(X.steps(secs)).orderBy("section_no", "step_no").collect()
    assert [(r.section_no, r.step, r.group_no) for r in steps] == [(1, "Tap Wi-Fi.", 1), (1, "Open Settings.", 2), (2, "Go to Settings.", 1), (2, "Open Settings again.", 2)]


def test_articles_that_give_nothing(spark):
    a = articles(spark, None, "", "  ", "one line only", "Title\r\nTap the icon")
    assert X.actions(a).count() == 0
    assert X.sections(articles(spark)).count() == 0


def test_article_without_headings_is_one_section(spark):
    rows = X.sections(articles(spark, "Title of it\nTap the icon")).collect()
    assert [(r.heading, r.body) for r in rows] == [("Title of it", ["Tap the icon"])]


def test_actions_are_ordered_by_disruption(spark):
    a = articles(spark, "# Reset\nRestart the device\n# Cable\nPlug the cable\n# Screen\nTap the icon on the screen")
    rows = X.actions(a).orderBy("action_no").collect()
    assert [r.category for r in rows] == ["auto", "manual", "critical"]
