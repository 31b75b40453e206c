"""Settings of the detector."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectorConfig:
    #: Samples that make a feature; also the divisor of its means, however many samples there are.
    samples_per_feature: int = 1000
    #: Features within this distance (inclusive) are neighbours.
    eps: float = 0.03
    #: Neighbours, itself included, that make a core point. The sequential detector takes 2.
    min_pts: int = 2
    #: A cluster must hold at least this share of the positions that it spans.
    min_locality: float = 0.2
    loss_thresh: int = 40
    #: Features in a window without an event; one more empties it.
    max_window: int = 100
    #: Voltage and current of a missing sample.
    filler: int = 2
    #: Share of its samples that a good feature has.
    good_share: float = 0.9
    #: Responses after which a batch is closed, complete or not.
    late_batches: int = 20
    #: Slots that are visited in turn after each response.
    ring_slots: int = 30
    #: Predecessors, and least stored features, that an early answer looks at.
    early_radius: int = 7
    early_least: int = 4
    #: What an event removes from the window: up to the end of the interval first found (forward), or of the tightened
    #: one (backward), or one feature more than that while later positions are told as if it were not (v1).
    trim: str = "forward"
    #: What is added to the middle of the reported interval; 0 in the answers of the batch detectors.
    point_shift: int = 1
    #: Whether a batch that never comes blocks all later ones; otherwise it counts as bad after late_batches.
    strict_block: bool = False
    #: Whether the window is tested for its size only when a feature arrives, not for each feature set in order.
    legacy_reset: bool = False


#: For the ``events`` table: ten samples a feature.
FIXTURE = DetectorConfig(samples_per_feature=10, eps=0.1)
