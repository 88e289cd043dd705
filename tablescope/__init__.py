"""tablescope -- automatic data analysis as Spark jobs.

Main entry points:

* ``tablescope.plans.analyze.analyze`` -- a source (path or DataFrame) to a
  profile, plan, task results, findings and written report in one call;
* ``tablescope.operators.profile.profile`` / ``profile_catalog`` -- column
  profiles of one table or many;
* ``tablescope.operators.analyses`` -- the analysis templates (histogram,
  value counts, group and cross aggregates, time series, hour of day,
  scatter, z-score outliers, overview);
* ``tablescope.operators.adhoc.ask_sql`` -- read-only ad-hoc SQL on a dataset;
* ``tablescope.streaming.run_state.run_state_stream`` -- the run log's latest
  state maintained by Structured Streaming.

Every function takes and returns DataFrames; see README.md for the design.
"""
