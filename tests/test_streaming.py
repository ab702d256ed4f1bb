from pdf_maker import make_pdf, text

from pagemill.streaming.pages import convert_stream, scan_stream


def test_files_as_they_arrive(spark, tmp_path):
    src, out, chk = tmp_path / "in", tmp_path / "out", tmp_path / "chk"
    src.mkdir()
    (src / "a.pdf").write_bytes(make_pdf([text(50, 700, "first")]))
    convert_stream(spark, str(src), str(out), str(chk)).awaitTermination()
    (src / "b.pdf").write_bytes(make_pdf([text(50, 700, "second")]))
    convert_stream(spark, str(src), str(out), str(chk)).awaitTermination()
    assert sorted(r.text.strip() for r in spark.read.parquet(str(out)).collect()) == ["first", "second"]
    q = scan_stream(spark, str(src)).writeStream.format("memory").queryName("scanned").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from scanned").count() == 2
