"""The window network's steps against plain sums."""

import numpy as np

from cladeforge.llm import lm


def test_a_step_moves_parameters_by_plain_sums_and_takes_each_power_once(monkeypatch):
    """One Adagrad step on repeated words against gradients that are added up word by word."""
    rng = np.random.default_rng(4)
    line = rng.integers(0, 40, 300)
    around, target = lm.positions([line[:200], line[200:]])
    old, trainer = lm.Network(), lm.Trainer()
    old.counts += np.bincount(target, minlength=lm.VOCAB)
    powers, exp = [], np.exp
    monkeypatch.setattr(lm.np, "exp", lambda x, **kw: powers.append(x.size) or exp(x, **kw))
    trainer.step(around, target)
    monkeypatch.undo()
    assert sum(powers) == len(target) * (lm.CLASSES + lm.MEMBERS)
    table, w3, prior = np.zeros(old.table.shape), np.zeros(old.w3.shape), old.prior()
    for j, t in enumerate(target):
        h = np.tanh(old.b1 + sum(old.table[k][a[j]] for k, a in enumerate(around)))
        c, m = t % lm.CLASSES, t // lm.CLASSES
        outs = []
        for logits, at in ((h @ old.w2 + old.b2, c), (h @ old.w3[c] + prior[c], m)):
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[at] -= 1
            outs.append(p / len(target))
        w3[c] += np.outer(h, outs[1])
        back = (outs[0] @ old.w2.T + outs[1] @ old.w3[c].T) * (1 - h * h)
        for k, a in enumerate(around):
            table[k][a[j]] += back
    for got, start, g in ((trainer.net.table, old.table, table), (trainer.net.w3, old.w3, w3)):
        np.testing.assert_allclose(got, start - trainer.rate * g / np.sqrt(1e-4 + g * g), atol=2e-5)
