import numpy as np
import pytest

from checks import queries
from newsfold.operators import kernels

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("terms, m, n", [(0, 3, 4), (1, 1, 5), (5, 3, 7), (300, 40, 500)])
def test_landmark_products(terms, m, n, monkeypatch):
    draw = np.random.default_rng(terms)
    matrix = np.where(draw.random((terms, m)) < draw.random((terms, 1)) ** 2, draw.normal(size=(terms, m)), 0)
    x = np.where(draw.random((n, terms)) < 0.2, draw.normal(size=(n, terms)), 0)
    rows, place = np.nonzero(x)
    table = kernels.LandmarkTerms.of(matrix)
    for block in (kernels.BLOCK_NUMBERS, 50):
        monkeypatch.setattr(kernels, "BLOCK_NUMBERS", block)
        assert np.allclose(table.products(rows, place, x[rows, place], n), x @ matrix)


def test_a_term_of_one_landmark_costs_one_step_and_not_one_for_each_landmark():
    matrix = np.zeros((1000, 200))
    matrix[np.arange(1000), np.arange(1000) % 200] = 2.0
    matrix[0] = 1.0
    table = kernels.LandmarkTerms.of(matrix)
    assert table.common.shape == (1, 200) and len(table.weight) == 999
    assert (np.diff(table.first) == [0] + [1] * 999).all()


def test_svm_queries_turn_titles_into_vectors_once(spark, capsys):
    for frame in queries._vectors(spark, DATA):
        frame.explain()
        plan = capsys.readouterr().out
        assert "ExistingRDD" in plan and "UDF" not in plan and "regexp_extract_all" not in plan
