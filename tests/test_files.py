from pyspark.sql import functions as F

from locusweave.functions import sequences as seq
from locusweave.sources import readers, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_gff(spark, tmp_path):
    p = write(tmp_path / "a.gff3", "#c\nchr1\ts\tgene\t100\t900\t.\t+\t.\tID=gene:G1;Name=a=b;flag\nchr1\ts\tmRNA\t1\t2\t.\t+\t.\tID=T\nbad\n")
    r = readers.read_gff3(spark, p).collect()
    assert [(x["id"], x["start"], x["end"], x["strand"]) for x in r] == [("G1", 100, 900, "+")]


def test_fasta_round_trip(spark, tmp_path):
    p = write(tmp_path / "a.fa", ">a one\nACGT\nAC*G\n>b\nTT\n")
    r = readers.read_fasta(spark, p)
    assert sorted((x["id"], x["sequence"]) for x in r.collect()) == [("a", "ACGTAC*G"), ("b", "TT")]
    sinks.write_fasta(r, "id", "sequence", str(tmp_path / "out"), wrap=3)
    back = readers.read_fasta(spark, str(tmp_path / "out"))
    assert sorted((x["id"], x["sequence"]) for x in back.collect()) == [("a", "ACGTACG"), ("b", "TT")]


def test_hits(spark, tmp_path):
    p = write(tmp_path / "h.tsv", "q1\tG1|chr1|100|900|+|1\t91.2\t260\t20\t1\t1\t260\t3\t262\t1e-90\t410.0\nq2\tG2\tx\t1\t1\t1\t1\t1\t1\t1\t0\t5\n")
    r = {x["qseqid"]: x for x in readers.read_blast_tab(spark, p).collect()}
    assert (r["q1"]["subject"], r["q1"]["start"], r["q1"]["row_index"]) == ("G1", 100, 1)
    assert (r["q2"]["chromosome"], r["q2"]["pident"], r["q2"]["start"]) == ("Unknown", None, None)


def test_records(spark, tmp_path):
    p = write(tmp_path / "a.pf", "ID\tp1\nNAME\tn\nEC\t1.1.1.1\nEC\t2.2.2.2\n//\nID\tp2\n")
    assert sorted((x["protein_id"], x["ec_numbers"]) for x in readers.read_pf(spark, p).collect()) == [("p1", ["1.1.1.1", "2.2.2.2"]), ("p2", [])]
    d = write(tmp_path / "a.dat", 'UNIQUE-ID - U1\nDBLINKS - (A "x")\nGENE - g\n//\n')
    assert readers.read_frames(spark, d).first()["dblinks"] == ['(A "x")']


def test_newick(spark, tmp_path):
    tips, edges = readers.read_newick(spark, write(tmp_path / "t.nwk", "((a:1,b:2)x:1,(c,d,e));"))
    assert {(r["clade_id"], r["tip"]) for r in tips.collect()} == {(0, t) for t in "abcde"} | {(4, t) for t in "cde"}
    assert edges.count() == 7


def test_functions(spark):
    df = spark.createDataFrame([("ATGTAAGGN",)], "s string").select(
        seq.translate_dna(F.col("s")).alias("p"), seq.reverse_complement(seq.reverse_complement(F.col("s"))).alias("same"), F.lit("x").alias("o")
    )
    assert tuple(df.first())[:2] == ("M*X", "ATGTAAGGN")


def test_short_hits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("q\ts\t70\t9\t1e-5\t33.5\nq\tt\t69.9\t9\t0\t1\nq\tt\t80\n\nq\tu\tx\t9\t0\t1\n  q\tv\t99.5\t8\t0\t7\tmore\n")
    got = sorted(tuple(r) for r in readers.read_short_hits(spark, str(tmp_path / "a.txt")).collect())
    assert got == [("q", "s", 70.0, 9, 1e-5, 33.5, "a.txt"), ("q", "v", 99.5, 8, 0.0, 7.0, "a.txt")]


GBK = '''LOCUS       R1  100 bp
SOURCE      x
  ORGANISM  Planta una
COMMENT     ##Data-START##
            Orig. start  :: 1200
            Orig. end    :: >4800
FEATURES             Location/Qualifiers
     gene            1..30
                     /gene="not a cds"
     CDS             complement(join(10..20,30..41))
                     /gene="abc"
                     /gene="second"
                     /note="two
                     lines, ""quoted"""
                     /gene_functions="core"
                     /translation="MK
                     VL"
     CDS             50..60
                     /locus_tag="L2"
ORIGIN
        1 acgt
//
LOCUS       R2  9 bp
  ORGANISM  .
FEATURES
     CDS             1..9
//
LOCUS       R3  9 bp
ORIGIN
//
'''


def test_genbank(spark, tmp_path):
    write(tmp_path / "one.gbk", GBK)
    write(tmp_path / "dot.gbk", "LOCUS  D\n  ORGANISM  .\nFEATURES\n     CDS             4..8\n//\n")
    r = readers.read_genbank(spark, str(tmp_path))
    got = sorted((tuple(x) for x in r.where("source_file = 'one.gbk'").collect()), key=lambda x: (x[11], x[5]))
    assert got[0] == ("Planta una", "abc", None, None, None, 10, 41, "-", "MKVL", 'two lines, "quoted"', "core", "R1", 1200, 4800, "one.gbk")
    assert got[1] == ("Planta una", None, "L2", None, None, 50, 60, "+", "", None, None, "R1", 1200, 4800, "one.gbk")
    assert got[2] == (".", None, None, None, None, 1, 9, "+", "", None, None, "R2", None, None, "one.gbk") and len(got) == 3
    assert [tuple(x) for x in readers.genbank_clusters(r).collect()] == [("one", "Planta una", 1200, 4800, 3600)]


def test_mixed_files(spark, tmp_path):
    write(tmp_path / "a.csv", " ID ,Start\n1,2\nshort\n3,4,5\n\"x,y\",6\n")
    write(tmp_path / "b.csv", "id\tName\n7\tn\n")
    write(tmp_path / "c.csv", " ID ,Start\n8,9\n")
    write(tmp_path / "empty.csv", "")
    write(tmp_path / "only_header.csv", "id,zeta\n")
    got = readers.read_csvs(spark, str(tmp_path))
    assert set(got.columns) == {"id", "start", "name", "zeta", "source_file"}
    assert sorted((r["id"], r["start"], r["name"], r["source_file"]) for r in got.collect()) == [("1", "2", None, "a.csv"), ("7", None, "n", "b.csv"), ("8", "9", None, "c.csv"), ("x,y", "6", None, "a.csv")]
    bad = readers.read_csvs(spark, str(tmp_path), bad="line").where("line is not null").collect()
    assert sorted(r["line"] for r in bad) == ["3,4,5", "short"]


def test_canonical_transcripts_sort_genes_once(spark, tmp_path):
    p = write(tmp_path / "t.gff3", "".join(f"c\ts\tmRNA\t1\t2\t.\t+\t.\tID=transcript:t{i};Parent=gene:g\nc\ts\tCDS\t1\t{9 - i % 2}\t.\t+\t.\tParent=transcript:t{i}\n" for i in range(4)))
    got = readers.canonical_transcripts(readers.read_gff3(spark, p, kind=None))
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [gene") == 1
    assert [tuple(r) for r in got.collect()] == [("g", "t2", 9, 1, 9)]
