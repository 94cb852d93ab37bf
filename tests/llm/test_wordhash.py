import random

import pyarrow as pa
import regex

from lexweave.llm.wordhash import string_bytes, word_spans

ALONE = r"[々-〇ぁ-ヿ㐀-鿿豈-﫿ｦ-ﾟ฀-໿က-Ⴟក-៿\U00020000-\U0002ffff]"
WORDS = regex.compile(ALONE + r"|(?:[A-Za-z0-9]|[^\x00-\x7f\u0080-©«-´¶-¹»-¿×÷ -⯿　-〄〈-〿＀-／：-＠［-｀｛-･])(?:(?!" + ALONE + r")(?:[A-Za-z0-9]|[^\x00-\x7f\u0080-©«-´¶-¹»-¿×÷ -⯿　-〄〈-〿＀-／：-＠［-｀｛-･]))*")


def split(texts):
    data, offsets = string_bytes(pa.array(texts))
    row, a, z = word_spans(data, offsets)
    out = [[] for _ in texts]
    for r, i, j in zip(row, a, z):
        out[r].append(data[i:j].tobytes().decode())
    return out


def test_words_of_several_scripts():
    texts = ["L'été — “deux” mots×2", "これはペンです。名前：Bob1さん", "", None, "ａｂＣ！？Straße", "ไทย abc", "Привет, мир…", "𠀀x한국어 말"]
    assert split(texts) == [["L", "été", "deux", "mots", "2"], [*"これはペンです", *"名前", "Bob1", *"さん"], [], [], ["ａｂＣ", "Straße"], [*"ไทย", "abc"], ["Привет", "мир"], ["𠀀", "x한국어", "말"]]


def test_against_an_expression():
    rng = random.Random(8)
    pool = "ab1 .,-é×÷µ§ —…“漢字かなカ゛ﾊ。、！Ａ１〆々〇ไ한글жü\U00020001\U0001f600\n"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(400)]
    assert split(texts) == [WORDS.findall(t) for t in texts]
