from quire.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, body string"


def test_links_nested_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?", "x"),
        (1, 1, "assistant", "> How are   you?\nFine.\n\nAnd you?", None),
        (1, 2, "user", "New topic", None),
        (1, 3, "user", ">> how are you?\n> Fine.\nGood to hear.", None),
        (1, 4, "user", "> never said\nAlone", None),
        (2, 0, "user", None, None),
        (2, 1, "user", ">", None),
        (None, None, None, "> Fine.", None),
    ]
    out = {(r.conv, r.turn): r for r in chat.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(rows)
    assert [out[1, t].parent_turn for t in range(5)] == [None, 0, None, 1, None]
    assert [out[1, t].depth for t in range(5)] == [0, 1, 0, 2, 0]
    assert [out[1, t].root_turn for t in range(5)] == [0, 0, 2, 0, 4]
    assert [out[1, t].position for t in range(5)] == [0, 1, 3, 2, 4]
    assert out[1, 1].body == "Fine.\n\nAnd you?" and out[1, 3].body == "Good to hear." and out[2, 0].body == "" and out[2, 1].body == ""
    assert out[None, None].parent_turn is None


def test_partial_quotes(spark):
    rows = [
        (1, 0, "u", "One.\nTwo.\nThree.\n\nFour\nfive.\n\nSix.", ""),
        (1, 1, "a", "Six.\nSeven.", ""),
        (1, 2, "u", "> One.\n> Two.\nLines.", ""),
        (1, 3, "a", "> Four five.\n>\n> Six.\nParagraphs, filled anew.", ""),
        (1, 4, "u", "> Six.\n> Seven.\nWhole.", ""),
        (1, 5, "a", "> Eight.\n> Nine.\nNowhere.", ""),
    ]
    out = {r.turn: r for r in chat.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[t].parent_turn for t in range(6)] == [None, None, 0, 0, 1, None]
    assert out[3].root_turn == 0 and out[3].body == "Paragraphs, filled anew."


def test_empty_and_repeated(spark):
    assert chat.reply_order(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = [(1, 0, "u", "a", ""), (1, 0, "u", "a", ""), (1, 1, "u", "> a\nb", "")]
    out = chat.reply_order(spark.createDataFrame(twice, SCHEMA)).collect()
    assert sorted((r.turn, r.position) for r in out) == [(0, 0), (0, 1), (1, 2)]
