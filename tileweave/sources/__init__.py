"""Where rows come from (files, literal dimension tables) and where they go."""
