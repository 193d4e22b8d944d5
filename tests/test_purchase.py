"""What a marketplace page offers, on odd pages."""

from shelfline.functions import purchase as P


def actions(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "key long, html string")
    return {r.key: r for r in P.with_action(df).collect()}


def test_nothing_in_nothing_out(spark):
    assert P.with_action(spark.createDataFrame([], "key long, html string")).count() == 0
    got = actions(spark, None, "", "<p>", "<button></button>")
    assert [(got[i].action, got[i].examined) for i in range(4)] == [("none", 0), ("none", 0), ("none", 0), ("none", 1)]


def test_surroundings_exclude_up_to_six_levels_and_not_beyond_the_body(spark):
    button = "<button>Acheter maintenant</button>"
    near = "<div class='mbb-offer'>" + "<i>" * 5 + button
    far = "<div class='mbb-offer'>" + "<i>" * 6 + button
    body = "<body class='sponsored'>" + button
    got = actions(spark, near, far, body)
    assert [(got[i].action, got[i].ignored) for i in range(3)] == [("none", 1), ("buy_now", 0), ("buy_now", 0)]


def test_first_deciding_element_of_a_kind_in_the_page_counts(spark):
    html = "<a id='my-invite' class='share'>Inviter</a><a id='other-invite'>Demander une invitation</a>"
    assert actions(spark, html)[0].origin == "libellé de contrôle"  # the first is excluded, the second speaks for itself


def test_buttons_are_read_before_inputs_and_only_so_many(spark):
    html = "<input type='submit' value='Acheter maintenant'>" + "<button>Rien</button>" * 199 + "<button>Notify me</button><button>Précommander</button>"
    got = actions(spark, html, "<button>Rien</button>" * 300 + "<button id='buy-now-button'></button>")
    assert (got[0].action, got[0].examined) == ("notify_me", 201)
    assert (got[1].action, got[1].label, got[1].examined) == ("buy_now", "(libellé illisible)", 200)


def test_confidence_counts_signs(spark):
    df = spark.createDataFrame([(True, None, False, True)], "a boolean, b boolean, c boolean, d boolean")
    assert df.select(P.confidence(*(df[c] for c in "abcd"), df["a"] | df["b"])).first()[0] == 60
