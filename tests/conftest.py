from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from evalspark.session import local_session  # noqa: E402
from oracle import DATA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "evalspark-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def public_files(tmp_path_factory):
    """Small made-up files in the layout of the public ones."""
    out = tmp_path_factory.mktemp("public")
    rng = np.random.default_rng(7)
    lines = ["sepal_length,sepal_width,petal_length,petal_width,species"]
    centres = {"setosa": (5.0, 3.4, 1.5, 0.2), "versicolor": (5.9, 2.8, 4.3, 1.3), "virginica": (6.6, 3.0, 5.6, 2.0)}
    for species, centre in centres.items():
        for _ in range(50):
            lines.append(",".join(f"{v:.3f}" for v in rng.normal(centre, 0.25)) + f",{species}")
    (out / "iris.csv").write_text("\n".join(lines) + "\n")

    head = "PassengerId,Survived,Pclass,Name,Sex,Age,SibSp,Parch,Ticket,Fare,Cabin,Embarked"
    lines = [head]
    for i in range(1, 892):
        female = rng.random() < 0.35
        survived = int(rng.random() < (0.75 if female else 0.2))
        title = "Mrs" if female else rng.choice(["Mr", "Master", "Dr"], p=[0.9, 0.08, 0.02])
        age = "" if rng.random() < 0.2 else f"{rng.integers(1, 80)}"
        cabin = f"C{i}" if rng.random() < 0.2 else ""
        port = rng.choice(["S", "C", "Q", ""], p=[0.7, 0.2, 0.09, 0.01])
        lines.append(
            f'{i},{survived},{rng.integers(1, 4)},"Person{i}, {title}. Given ""Nick"" {i}",'
            f'{"female" if female else "male"},{age},{rng.integers(0, 4)},{rng.integers(0, 3)},T{i},'
            f"{rng.uniform(5, 200):.4f},{cabin},{port}"
        )
    (out / "titanic.csv").write_text("\n".join(lines) + "\n")

    spam = [f"WIN prize {i} call now free entry" for i in range(30)]
    ham = [f'see you at {i} "later" ok' for i in range(120)]
    rows = [f"spam\t{t}" for t in spam] + [f"ham\t{t}" for t in ham] + ["ham\tok", "ham\tok", "ham\t\"unclosed quote"]
    (out / "sms_spam.tsv").write_text("\n".join(rows) + "\n")

    lines = ["review,sentiment"]
    for i in range(40):
        lines.append(f'"A fine film {i},<br /><br>truly ""great"".\nSee it. ",positive')
        lines.append(f'"A dull film {i}, awful and slow.",negative')
    (out / "imdb.csv").write_text("\n".join(lines) + "\n")

    lines = ["category,text"]
    topics = {"business": "market profit bank", "entertainment": "film music award", "politics": "party vote minister",
              "sport": "match goal team", "tech": "software phone internet"}
    for i in range(20):
        lines += [f"{c},{t} story {i} {t}" for c, t in topics.items()]
    (out / "bbc_news.csv").write_text("\n".join(lines) + "\n")
    return str(out)
