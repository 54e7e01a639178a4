"""Largest eigenpairs of a symmetric operator that is known by its products only.

A block Jacobi-Davidson method: Rayleigh-Ritz over a subspace, which grows by the solutions of one
correction equation for each wanted pair. These are solved roughly by MINRES, all side by side, so
that every step asks for one product with a block of columns. Pairs whose residual has reached the
tolerance are locked and projected out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Product = Callable[[np.ndarray], np.ndarray]

#: A pair is exact when its residual is below so much of the largest eigenvalue.
TOLERANCE = 1e-13
#: Steps of MINRES for one correction, at most, and the part of the residual at which it stops.
INNER_STEPS = 6
INNER_RESIDUAL = 0.02
MOST_ROUNDS = 500


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the columns of ``against``."""
    lengths = np.linalg.norm(block, axis=0)
    block = block[:, lengths > 0] / lengths[lengths > 0]
    for _ in range(2):
        for basis in against:
            block = block - basis @ (basis.T @ block)
        left, values, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, values > 1e-8]
    return block


def _without(block: np.ndarray, locked: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Each column of ``block`` without its parts along ``locked`` and along its own column of ``own``."""
    for _ in range(2):
        block = block - locked @ (locked.T @ block)
        block = block - own * np.einsum("ij,ij->j", own, block)
    return block


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b != 0)


def _corrections(
    product: Product, locked: np.ndarray, ritz: np.ndarray, values: np.ndarray, residuals: np.ndarray
) -> np.ndarray:
    """Rough solutions t, orthogonal to locked and ritz, of (A - value) t = -residual, by MINRES."""
    right = _without(-residuals, locked, ritz)
    size = np.linalg.norm(right, axis=0)
    now, before = _ratio(right, np.broadcast_to(size, right.shape)), np.zeros_like(right)
    w, w_before, found = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    beta, left = size.copy(), size.copy()
    cos, cos_before = np.ones_like(size), np.ones_like(size)
    sin, sin_before = np.zeros_like(size), np.zeros_like(size)
    for _ in range(INNER_STEPS):
        image = _without(product(now) - now * values, locked, ritz)
        alpha = np.einsum("ij,ij->j", now, image)
        image = image - now * alpha - before * beta
        beta_next = np.linalg.norm(image, axis=0)
        diagonal = cos * alpha - cos_before * sin * beta
        first = np.hypot(diagonal, beta_next)
        second = sin * alpha + cos_before * cos * beta
        third = sin_before * beta
        cos_before, sin_before = cos, sin
        cos, sin = _ratio(diagonal, first), _ratio(beta_next, first)
        step = _ratio(now - w_before * third - w * second, np.broadcast_to(first, now.shape))
        w_before, w = w, step
        found = found + step * (cos * left)
        left = -sin * left
        before, now, beta = now, _ratio(image, np.broadcast_to(beta_next, image.shape)), beta_next
        if (np.abs(left) <= INNER_RESIDUAL * size).all():
            break
    return _without(found, locked, ritz)


def largest_eigenpairs(
    product: Product, size: int, wanted: int, tolerance: float = TOLERANCE, seed: int = 11
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues in falling order, and their unit eigenvectors as columns.

    ``product`` multiplies a block of columns by the operator, which must be symmetric. All
    residuals are below ``tolerance`` times the largest eigenvalue, by products of their own.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, size)
    most = min(size, max(6 * wanted, 32))
    locked, locked_values = np.zeros((size, 0)), np.zeros(0)
    basis = _orthonormal(rng.standard_normal((size, min(size, 2 * wanted))))
    images = product(basis)
    for _ in range(MOST_ROUNDS):
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, images = basis @ turn, images @ turn
        open_pairs = min(wanted - len(locked_values), len(values))
        largest = max(float(np.abs(values).max(initial=0)), float(np.abs(locked_values).max(initial=0)))
        residuals = images[:, :open_pairs] - basis[:, :open_pairs] * values[:open_pairs]
        residuals -= locked @ (locked.T @ residuals)
        exact = np.linalg.norm(residuals, axis=0) <= tolerance * largest
        ready = int(np.argmin(exact)) if not exact.all() else open_pairs
        if ready:
            # Only products taken anew decide: images that were turned often have drifted.
            fresh = product(basis[:, :ready])
            images[:, :ready] = fresh
            off = fresh - basis[:, :ready] * values[:ready]
            off -= locked @ (locked.T @ off)
            exact = np.linalg.norm(off, axis=0) <= tolerance * largest
            ready = int(np.argmin(exact)) if not exact.all() else ready
            locked = np.hstack([locked, basis[:, :ready]])
            locked_values = np.concatenate([locked_values, values[:ready]])
            basis, images, values = basis[:, ready:], images[:, ready:], values[ready:]
            residuals, open_pairs = residuals[:, ready:], open_pairs - ready
        if len(locked_values) == wanted:
            order = np.argsort(-locked_values, kind="stable")
            return locked_values[order], locked[:, order]
        if basis.shape[1] + open_pairs > most:
            kept = min(basis.shape[1], open_pairs + wanted)
            basis, images = basis[:, :kept], images[:, :kept]
        if len(locked_values) + basis.shape[1] < size:
            tried = _corrections(product, locked, basis[:, :open_pairs], values[:open_pairs], residuals)
            added = _orthonormal(tried, locked, basis)
            if not added.shape[1]:
                added = _orthonormal(rng.standard_normal((size, max(open_pairs, 1))), locked, basis)
        else:  # the subspace is all there is: its images are taken anew
            basis, added = np.zeros((size, 0)), _orthonormal(basis, locked)
            images = np.zeros((size, 0))
        basis, images = np.hstack([basis, added]), np.hstack([images, product(added)])
    raise ArithmeticError(f"residuals did not reach {tolerance} of the largest eigenvalue")
