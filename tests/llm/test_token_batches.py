from pagelens.llm import tokens


def test_new_words_and_numbers_are_encoded_together(monkeypatch):
    ids, calls = tokens.Ids(tokens.vocabulary(), 4), []
    encoded = tokens.Ids.encoded
    monkeypatch.setattr(tokens.Ids, "encoded", lambda self, text: calls.append(text) or encoded(self, text))
    text = "First qzx 12, 3.5% 7) don't' (ab) x_1 <|endoftext|> a<|endoftext|> 9\n10! 11\n\n 12? é　x 4"
    whole = tokens.tokenizer(tokens.vocabulary()).encode(text, add_special_tokens=False).ids
    assert memoryview(ids.of(text)).cast("I").tolist() == whole
    # Only the first word, what has a special token or ends with other signs is on its own.
    assert any(" 3.5%" in c and " 7)" in c for c in calls)
