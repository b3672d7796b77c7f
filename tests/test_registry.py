import pytest

from equilens.plans import registry


def test_adult_layout(spark, tmp_path):
    p = tmp_path / "adult"
    p.mkdir()
    (p / "train.csv").write_text(
        "39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50K\n"
        "50, ?, 83311, Bachelors, 13, Married, Exec, Husband, White, Male, 0, 0, 13, United-States, >50K\n")
    (p / "test.csv").write_text("|1x3 Cross validator\n"
                                "25, Private, 226802, 11th, 7, Never-married, Machine, Own-child, Black, Female, 0, 0, 40, United-States, >50K.\n")
    df, spec = registry.load(spark, "UCI Adult", str(p))
    rows = {r["fnlwgt"]: r for r in df.collect()}
    assert len(rows) == 3 and rows[83311]["workclass"] == "?"          # '?' kept as a category
    assert (rows[77516]["income"], rows[83311]["income"], rows[226802]["income"]) == (0, 1, 1)
    assert spec.sensitive == ["sex", "race"]


def test_student_and_titanic_layouts(spark, tmp_path):
    s = tmp_path / "student.csv"
    s.write_text("sex;age;studytime;G3\nF;18;2;12\nM;17;1;8\n")
    df, spec = registry.load(spark, "Student Performance", str(s))
    assert "G3" not in df.columns and sorted(r["pass"] for r in df.collect()) == [0, 1]
    t = tmp_path / "titanic.csv"
    t.write_text(" Pclass ,Gender,Age,SibSp,Parch,Fare,Embarked,Survived,Name\n"
                 "1,female,38,1,0,71.2,C,1,a\n3,male,,0,0,7.9,,0,b\n3,male,26,0,0,8.0,S,0,c\n")
    df, spec = registry.load(spark, "Titanic", str(t))
    assert df.columns[:8] == registry.TITANIC_KEEP
    r = {x["fare"]: x for x in df.collect()}
    assert r[7.9]["age"] == 32.0 and r[7.9]["embarked"] == "C"          # median / mode (tie -> smallest)


def test_unknown_name(spark):
    with pytest.raises(KeyError):
        registry.load(spark, "nope")
