"""The scoreboard's memory: hand-made runs of samples."""

from trackweave.plans.board import Board, Clock, Quarter, Reading, follows, misread, resyncs


def run(board, samples, at=0.0):
    out = []
    for k, s in enumerate(samples):
        r = None if s is None else Reading(s[:2], s[2] if len(s) > 2 else 1, s[3] if len(s) > 3 else 700 - int(at) - k)
        out += board.sample(at + k, r)
    return [(o[0], o[1], o[2]) for o in out]


def test_rules_on_pairs():
    assert follows((50, 48), (50, 48)) and follows((53, 48), (50, 48)) and not follows((51, 49), (50, 48)) and not follows((54, 48), (50, 48)) and not follows((49, 48), (50, 48))
    assert misread((58, 48), (50, 48)) == (51, 48) and misread((50, 90), (50, 48)) is None and misread((51, 48), (50, 48)) is None
    assert resyncs((55, 53), (50, 48)) and not resyncs((63, 48), (50, 48)) and not resyncs((50, 47), (50, 48)) and not resyncs((51, 48), (50, 48))


def test_start_is_the_majority_at_its_last_sample():
    board = Board()
    assert run(board, [(45, 43), (46, 43), (45, 43), (45, 43), (45, 48), (45, 43)]) == [(3.0, 45, 43)]
    assert board.score == (45, 43)


def test_a_change_needs_two_readings_and_has_the_time_of_the_first():
    board = Board()
    run(board, [(45, 43)] * 6)
    assert run(board, [(47, 43), (45, 43), (47, 43), (47, 43)], 6.0) == [(8.0, 47, 43)]


def test_a_misreading_counts_for_what_was_meant():
    board = Board()
    run(board, [(50, 43)] * 6)
    assert run(board, [(58, 43), (51, 43)], 6.0) == [(6.0, 51, 43)]


def test_three_equal_readings_resync():
    board = Board()
    run(board, [(50, 43)] * 6)
    assert run(board, [(55, 48)] * 3, 6.0) == [(6.0, 55, 48)]


def test_clock_runs_stops_and_waits():
    clock = Clock()
    for value in (600, 599, None, 597):
        clock.read(value, 1)
    assert clock.now == 597 and clock.running
    clock.miss()
    clock.miss()
    assert clock.now == 595 and clock.running
    clock.miss()
    assert clock.now == 595 and not clock.running
    clock.read(592, 1)  # back after three samples
    assert clock.now == 592 and clock.running
    clock.read(592, 1)
    assert not clock.running
    clock.read(400, 1)  # a jump is not believed
    assert clock.now == 592
    for _ in range(10):
        clock.miss()
    clock.read(550, 1)
    assert clock.now == 550
    for _ in range(10):
        clock.miss()
    clock.read(300, 1)  # too far away; two samples had passed before the board was surely gone
    assert clock.now == 548


def test_quarter_moves_one_on_with_two_votes():
    quarter = Quarter()
    assert [quarter.read(*r) for r in ((2, 300), (1, 300), (4, 700), (3, 100), (3, 715), (None, None), (3, 714))] == [2, 2, 2, 2, 2, 2, 3]


def test_state_survives_as_a_dict():
    samples = [(45, 43)] * 6 + [(47, 43), None, (47, 43), (58, 43), (48, 43), (48, 46), (48, 46)]
    whole, board, parts = Board(), Board(), []
    for k, s in enumerate(samples):
        board = Board.from_dict(board.as_dict())
        parts += run(board, [s], float(k))
    assert parts == run(whole, samples)


def test_timeline(spark):
    from trackweave.plans.board import board_timeline

    rows = [("v", float(k), 45 if k < 7 else 47, 43, "1ST", f"11:{50 - k:02d}") for k in range(10)] + [("v", 10.0, None, None, None, None)]
    got = board_timeline(spark.createDataFrame(rows, "video string, time_sec double, team1_score int, team2_score int, quarter string, game_clock string"))
    assert [tuple(r)[1:] for r in got.orderBy("analysis_time").collect()] == [("00:00:04", 45, 43, "1Q", "11:46"), ("00:00:07", 47, 43, "1Q", "11:43")]
