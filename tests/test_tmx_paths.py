import re

from bitloom.sources import tmx


def test_local_paths_need_no_call_of_the_jvm(spark, tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / f"file={k}").mkdir()
        (tmp_path / f"file={k}" / "a.txt").write_text(f"<tmx><header srclang='en'/><body><tu tuid='{k}'><tuv xml:lang='en'><seg>a</seg></tuv><tuv xml:lang='bg'><seg>b</seg></tuv></tu></body></tmx>")
    monkeypatch.setattr(tmx, "_hadoop", None)
    for at in (f"file://{tmp_path}/*/*.txt", f"{tmp_path}/*/*.txt"):
        files = tmx.discover(at)
        assert [x.tu_id for x in tmx.read_tmx(spark, files[::-1]).orderBy("ordinal").collect()] == ["2", "1", "0"]
    short = [re.sub("^file:/+", "file:/", x) for x in tmx.discover(f"file://{tmp_path}/*/*.txt")]  # as Hadoop prints them
    assert tmx.read_tmx(spark, short).count() == 3


def test_prefixes():
    pattern = r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]"
    for x in ("<a:b c:d='1' 9x:y>", "</q.r-s:t> e:1 f: g :h:i j:k:l", ":a", "a:b", "<é:x <_y:z\n_w:_", "", "x/y:z"):
        assert tmx._prefixes(x) == set(re.findall(pattern, x))
