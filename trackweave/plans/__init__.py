"""Whole analyses composed of the operators: tracking clean-up, events, scoreboards, play-by-play features, scoring."""
