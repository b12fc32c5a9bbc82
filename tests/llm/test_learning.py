import numpy as np

from harrow.llm import language, learning
from harrow.llm.learning import Ftrl


def test_the_number_of_groups_does_not_set_the_penalty(spark, monkeypatch):
    """The same rows learnt by one group and by six: weights of like size, the same languages."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = []
    for groups in (1, 6):
        monkeypatch.setattr(learning, "PARTS", groups)
        monkeypatch.setattr(learning, "PART_ROWS", 1)
        models.append(language.fit(docs))
    one, six = (m.dense for m in models)
    assert 0.6 < np.abs(six).sum() / np.abs(one).sum() < 1.6
    assert 0.5 < (six != 0).sum() / (one != 0).sum() < 2.5
    assert np.corrcoef(one.ravel(), six.ravel())[0, 1] > 0.8
    texts = [r.text for r in docs.select("text").limit(300).collect() if r.text]
    assert sum(models[0].predict(t)[0] == models[1].predict(t)[0] for t in texts) > 0.98 * len(texts)


def test_one_step_by_hand():
    """The first step from nothing: z is the gradient, n its square, and weights follow from both."""
    own = Ftrl((3,), alpha=0.5, l1=0.1, l2=0.01)
    at = np.array([0, 2])
    gradient = np.array([0.6, -0.05], np.float32)
    own.update(at, own.weights(at), gradient)
    assert np.allclose(own.z, [0.6, 0, -0.05]) and np.allclose(own.n, [0.36, 0, 0.0025])
    assert np.allclose(own.weights(), [-(0.6 - 0.1) / ((1 + 0.6) / 0.5 + 0.01), 0, 0])
    before = own.weights(at)
    own.update(at, before, np.array([0.2, 0.3], np.float32))
    sigma = (np.sqrt(0.36 + 0.04) - 0.6) / 0.5
    assert np.allclose(own.z[0], 0.6 + 0.2 - sigma * before[0])


def test_cumulative_link_gradient_against_finite_differences():
    """What one row adds to z (no weights yet) and to the thresholds is the slope of its log loss."""
    from harrow.llm import toxicity

    def loss(s, t, grade):
        p = 1 / (1 + np.exp(-(np.array(t) - s)))
        upper, lower = (p[grade] if grade < len(t) else 1.0), (p[grade - 1] if grade else 0.0)
        return -np.log(upper - lower)

    for grade in range(toxicity.GRADES):
        model = toxicity.SeverityModel()
        start = model.thresholds.copy()
        model.learn(iter([("vile words here", grade)]))
        at = model.features("vile words here")
        slope = (loss(1e-5, start, grade) - loss(-1e-5, start, grade)) / 2e-5
        assert np.allclose(model.ftrl.z[at], slope, atol=1e-4)
        for k in range(len(start)):
            step = np.zeros(len(start))
            step[k] = 1e-5
            own = (loss(0, start + step, grade) - loss(0, start - step, grade)) / 2e-5
            assert np.isclose(model.squares[k] - 1, own * own, atol=1e-4)
            assert np.sign(model.thresholds[k] - start[k]) == -np.sign(np.round(own, 9))
